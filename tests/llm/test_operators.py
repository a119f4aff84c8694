"""Every operator against brute force on a small table with every odd case."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import regex

import corpus_pipeline
from tallyframe.llm import bpe, components, decontam, exact_dedup, line_dedup, minhash, packing, sstable, substring_dedup, token_counts, toxicity, url_filter, words
from tallyframe.llm.common import Scratch

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def ids_of(text, end):
    enc = bpe.encoder(bpe.vocabulary())
    return [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    enc = bpe.encoder(bpe.vocabulary())
    odd = ["", "a  b\n\n's x's  'll\t12½ ²³ _", "<|endoftext|>x<|endoftext|>", "日本 语", "\x1c\x1d a", " ", "\r\n x"]
    assert enc.encode(odd) == [enc.whole(t) for t in odd]


def test_plain_pattern_equals_library_classes():
    plain = [chr(c) for c in range(0x58F) if not bpe.PLAIN_ONLY.search(chr(c))]
    rng, want, got = random.Random(5), regex.compile(bpe.PATTERN).findall, re.compile(bpe.plain_pattern()).findall
    texts = [f"a{c} {c}{c}1{c}  {c}" for c in plain] + ["".join(rng.choices(plain + [" ", "'s", "\n"] * 200, k=300)) for _ in range(200)]
    assert all(got(t) == want(t) for t in texts)
    enc = bpe.encoder(bpe.vocabulary())
    assert enc.encode(texts) == [enc.whole(t) for t in texts]


def test_piece_table_is_bounded_by_bytes():
    table = bpe.PieceTable(SimpleNamespace(tokenize=lambda spelled: [SimpleNamespace(id=len(spelled))]), lambda ids: ids[0].to_bytes(4, "little"))
    for n in range(1 << 20, (1 << 20) + 80):
        assert table["x" * n] == n.to_bytes(4, "little")
        assert sum(2 * len(piece) + len(ids) for piece, ids in table.items()) <= 64 << 20
    assert table["x" * (40 << 20)] == (40 << 20).to_bytes(4, "little") and len(table) < 80


def test_packing_round_trip(spark, docs, empty):
    out = packing.pack(docs, bpe.vocabulary(), window=64).collect()
    want = Counter((d, tuple(ids_of(t, 0))) for d, t in docs.select("doc_id", "text").collect())
    sequences, per_doc = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append((r.start, r.doc_tokens, tuple(ids)))
    last = max(sequences)
    for number, places in sequences.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == 64 or number == last
    got = Counter()
    for doc, parts in per_doc.items():
        copies = sum(1 for s, _, _ in parts if s == 0)
        joined = [x for s, _, ids in sorted(parts) for x in ids]
        assert len(joined) == sum(n for s, n, _ in parts if s == 0)
        got[doc] += copies
    assert got == Counter(d for d, n in want.items() for d in [d[0]] * n)
    assert packing.pack(empty, bpe.vocabulary()).collect() == []


def test_sstable_round_trip_and_lookup(docs, empty):
    manifest = sstable.write_shards(docs, bpe.vocabulary(), target_mb=1)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    want = sorted(((d, ids_of(t, 2)) for d, t in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got)) == sorted((d is not None, d or 0, len(i), crc(i)) for d, i in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for doc, ids in want[1:6]:
        assert any(list(x) == ids for x in sstable.lookup(manifest, doc))
    assert len(sstable.lookup(manifest, 0)) == 2 and len(sstable.lookup(manifest, None)) == 1 and sstable.lookup(manifest, 10**6) == []
    assert sstable.read_shards(sstable.write_shards(empty, bpe.vocabulary())).collect() == []


def test_sstable_blocks_and_damage(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as out:
        writer = sstable.Writer(out, 2)
        for i in range(-50, 4000):
            writer.add(sstable.key_bytes(i), i.to_bytes(4, "little", signed=True) * 60)
        size = writer.finish()
        with pytest.raises(ValueError):
            writer.add(sstable.key_bytes(0), b"")
    reader = sstable.open_shard(str(path))
    assert len(reader.place) > 1 and reader.n_docs == 4050
    assert reader.get(sstable.key_bytes(-50))[0][:4] == (-50).to_bytes(4, "little", signed=True)
    assert reader.get(sstable.key_bytes(3999)) and not reader.get(sstable.key_bytes(4000))
    data = bytearray(path.read_bytes())
    data[reader.index_at + 1] ^= 1
    path.write_bytes(data)
    assert size == len(data)
    with pytest.raises(ValueError):
        sstable.open_shard(str(path))


def test_sstable_of_many_short_texts(spark):
    shards = sstable.write_shards(spark.range(100_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text"), bpe.vocabulary(), target_mb=1)
    counts = [r.n_docs for r in shards.select("n_docs").collect()]
    assert sum(counts) == 100_000 and max(counts) < 20_000
    got = sstable.read_shards(shards).selectExpr("count(DISTINCT doc_id) AS docs", "sum(n_tokens) AS ids", "max(start) AS last").first()
    assert (got.docs, got.ids, got.last) == (100_000, 100_000, 99_999)


def test_sstable_writer_of_many_keys(tmp_path):
    keys = [sstable.key_bytes(i) for i in range(0, 400_000, 2)]
    tracemalloc.start()
    with open(tmp_path / "x.sst", "wb") as out:
        writer, before = sstable.Writer(out, 2), tracemalloc.get_traced_memory()[0]
        for key in keys:
            writer.add(key, b"\2\0")
        writer.finish()
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 20 << 20
    reader = sstable.open_shard(str(tmp_path / "x.sst"))
    assert all(reader.get(key) == [b"\2\0"] for key in keys[::9999])
    # ten bits a key and seven hashes let about one absent key in a hundred through
    places = np.array([sstable._bloom_places(sstable._hashes(sstable.key_bytes(i)), 8 * len(reader.bloom)) for i in range(1, 4001, 2)]).reshape(2000, -1)
    assert ((reader.bloom[places >> 3] & (128 >> (places & 7))) > 0).all(axis=1).mean() < 0.03


def test_token_counts(docs, empty):
    got = {r.doc_id: r for r in token_counts.token_counts(docs, bpe.vocabulary()).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        n = len(ids_of(t, 0)) - 1
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len((t or "").encode()), n > 512)
    assert token_counts.token_counts(empty, bpe.vocabulary()).collect() == []


def test_token_counts_other_vocabularies(docs):
    import sentencepiece

    path = bpe.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {d: len(model.encode(t or "")) for d, t in docs.select("doc_id", "text").collect()}
    assert not token_counts.compiles(bpe.vocabulary("word_bpe_49k.json"))


def test_transducer_fuzz():
    import random

    enc = bpe.encoder(bpe.vocabulary())
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "r", "v", "l", "ll", "e", "m", "d", " ", "  ", "\n", "\t", "1", "é", "ß", "x", "_", "!", "'s", "²", "S", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    got = token_counts.count_texts(enc, token_counts.Counter(enc), texts)
    assert got.tolist() == [len(e.ids) for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_scan_composes_like_stepping():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 10, (37, 10)).astype(np.uint8)
    scanned, state = token_counts.compose_scan(maps), np.arange(10)
    for at in range(37):
        state = maps[at][state]
        assert (scanned[at] == state).all()


def test_transducer_table_refills(monkeypatch):
    enc = bpe.encoder(bpe.vocabulary())
    monkeypatch.setattr(token_counts.Counter, "MOST", 300)
    counter = token_counts.Counter(enc)
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        assert token_counts.count_texts(enc, counter, [text])[0] == len(enc.tokenizer.encode(text).ids)


def test_transducer_text_larger_than_its_table(monkeypatch):
    enc = bpe.encoder(bpe.vocabulary())
    text = " ".join(f"w{i * 7919}x{i}" for i in range(400)) + " " + "y" * 200
    want = len(enc.tokenizer.encode(text).ids)
    for most in (300, 100):  # the longest pre-token alone overflows the second
        monkeypatch.setattr(token_counts.Counter, "MOST", most)
        counter = token_counts.Counter(enc)
        assert token_counts.count_texts(enc, counter, ["a b", text, "c"]).tolist() == [2, want, 1]
        assert token_counts.count_texts(enc, counter, [text])[0] == want


def test_transducer_every_script():
    import random

    enc, rng = bpe.encoder(bpe.vocabulary()), random.Random(6)
    counter = token_counts.Counter(enc)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = ["".join(map(chr, codes[i : i + 5000])) for i in range(0, len(codes), 5000)]
    every += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}'s{chr(c)}!" for c in rng.sample(codes, 300)) for _ in range(40)]
    parts = ["“it’s”", "—", "…", "€", "日本語", "العربية", "हिन्दी", "😀", "👩‍👧", "\u2003", "\u3000", "\x1c", "\x85", "\u0558", "\u0590", "\U0010ffff", " ", "\n", "'s", "'", "a", "1", "٣", "!", "<|endoftext|>"]
    texts = every + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    want = [len(e.ids) for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(enc, counter, texts).tolist() == want


def test_transducer_counts_every_script_by_itself(monkeypatch):
    enc = bpe.encoder(bpe.vocabulary())
    counter, text = token_counts.Counter(enc), "“it’s” — 5 € … 日本語 العربية हिन्दी 😀\u3000x"
    want = len(enc.tokenizer.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(enc, "tokenizer", None)
    assert token_counts.count_texts(enc, counter, [text])[0] == want


def test_substring_dedup(docs, empty):
    rows = sorted((r for r in docs.select("doc_id", "text").collect()), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    seen, want = set(), Counter()
    for d, t in rows:
        w = SPACE.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = Counter(tuple(r) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == want
    assert substring_dedup.substring_dedup(empty).collect() == []


def packed_block(rows):
    import zstandard

    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return substring_dedup.Block(zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes()), True)


def test_substring_windows_are_told_apart_when_hashes_collide():
    """Every word gets one first hash, so only the second tells windows apart."""
    words_a, words_b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(25)]
    block = packed_block([(1, " ".join(words_a)), (2, " ".join(words_b)), (3, " ".join(words_a))])
    block.hash[:] = 5
    block.level(20, None, 64, True)
    assert len(np.unique(block.keys)) == 1 and len(block.keys) == 11 + 6
    assert block.repeats(np.ones(len(block.keys), bool)).nonzero()[0].tolist() == [*range(55, 66)]
    key = np.array([9], np.uint64)
    one = {"rng": 0, "n": 1, "keys": substring_dedup.pack_sorted(key), "ids": substring_dedup.pack_numbers(np.zeros(1, np.uint64)) + (3).to_bytes(8, "little")}
    rows = [one | {"block": b, "checks": np.array([c], np.uint64).tobytes()} for b, c in ((1, 7), (2, 8), (3, 7))]
    group = pa.Table.from_pylist(rows, pa.schema([("rng", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())]))
    bits = {r["block"]: r["bits"][4] >> 7 for r in substring_dedup._reply(2, True)(group).to_pylist()}
    assert bits == {1: 1, 2: 1, 3: 0}


def test_number_packing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert (substring_dedup.unpack_sorted(substring_dedup.pack_sorted(keys), len(keys)) == keys).all()


def test_url_filter(spark):
    import random

    rng = random.Random(3)
    rules = [url_filter.host_rule("com", "/", "allow"), url_filter.host_rule("example.com", "/en/", "block"), url_filter.host_rule("net", "/es/", "block"), url_filter.glob_rule("*.spam.**", "block"), url_filter.glob_rule("**/ads/*.js", "block")]
    hosts = ["example.com", "a.example.com", "EXAMPLE.com", "notexample.com", "x.net", "spam.org", "com", ""]
    urls = [None, "", "nonsense", "http://", "https://x.com", "http://x.org/example.com/en/", "http://x.org/a/ads/b.js?q", "http://x.org/ads/b/c.js", "http://e.net/es/" + "y" * 9000]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/es/1?a', '#t', '?x=/en/'])}" for _ in range(150)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.judge(df, rules).collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            want = max(fits)[1:]
        else:
            text = f".{host}{path}"
            bad = re.fullmatch(r"[^/]*\.spam\..*", text, re.S) or re.fullmatch(r".*/ads/[^/]*\.js", text, re.S)
            want = (None, "block" if bad else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want), r.url
    assert url_filter.judge(df.limit(0), rules).collect() == []


def test_shift_and_many_words():
    globs = [f"*a{i}b*" for i in range(60)] + ["**", "exact", "*"]
    machine = url_filter.ShiftAnd(globs)
    assert machine.words > 1
    hits = machine.match([b"xa17by", b"exact", b"a/b", b""])
    assert [globs[i] for i in np.flatnonzero(hits[0])] == ["*a17b*", "**", "*"]
    assert [globs[i] for i in np.flatnonzero(hits[1])] == ["**", "exact", "*"]
    assert [globs[i] for i in np.flatnonzero(hits[2])] == ["**"] and hits[3].sum() == 2


def test_shift_and_runs_on_with_few_lanes(monkeypatch):
    machine = url_filter.ShiftAnd([f"*a{i}b*" for i in range(40)] + ["**", "/*/x**", "abc"])
    texts = [b"a" + str(i).encode() + b"b" * i + b"/" * (i % 3) for i in range(30)] + [b"/q/x" * 900, b"", b"abc"]
    one = machine.match(texts)
    monkeypatch.setattr(url_filter, "FEW", 0)
    assert np.array_equal(one, machine.match(texts)) and one[:, -3].all()


def test_columns_come_back_whatever_their_names(spark, docs, bench):
    names = [c for c in docs.columns if c.startswith("__")]
    want = Counter(tuple(r) for r in docs.select("doc_id", *names).collect())
    assert Counter(tuple(r) for r in line_dedup.line_dedup(docs).select("doc_id", *names).collect()) == want
    for out in (decontam.decontaminate(docs, bench), minhash.deduplicate(docs)):
        assert out.columns == docs.columns and not Counter(tuple(r) for r in out.select("doc_id", *names).collect()) - want


def test_session_settings_are_left_alone(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    substring_dedup.substring_dedup(docs).collect()
    token_counts.token_counts(docs, bpe.vocabulary()).collect()
    assert spark.conf.get(name) == before


def test_exact_dedup(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    want = Counter()
    for d, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[d, keep, len(own), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_chunks_cover_and_resynchronise():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= exact_dedup.MOST
    moved = exact_dedup.chunks(b"shifted start " + data)
    assert len(set(parts) & set(moved)) > len(parts) / 2


def test_exact_dedup_survives_colliding_identifiers(docs):
    want = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect())
    spark = docs.sparkSession
    store = Scratch(spark, "collide")
    made = [(r.doc_id, r.text_sha256, [b"same"] if r.recipe else [], [bytes(r.proofs[0])] if r.recipe else []) for r in exact_dedup.recipes(docs).collect()]
    bad = spark.createDataFrame(made, exact_dedup.RECIPES)
    told, groups = exact_dedup.verified(store, bad, exact_dedup.grouped(store, bad, "groups"))
    assert sorted(g["count"] for g in told.groupBy("recipe").count().collect()) == sorted(Counter(r[4] for r in want.elements()).values())
    assert sorted(g.group_size for g in groups.collect()) == sorted(n for n in Counter(r[4] for r in want.elements()).values() if n > 1)


def test_exact_dedup_moves_no_text(docs):
    plans = []
    kept = Scratch.keep
    Scratch.keep = lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(self, df, name))[1]
    try:
        out = exact_dedup.exact_dedup(docs)
    finally:
        Scratch.keep = kept
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("MapInArrow" in p for p in plans)
    for plan in plans:
        assert "MapInArrow" not in plan or "Exchange" not in plan.split("MapInArrow")[0]  # texts are read by the first pass alone


def test_line_dedup(spark, empty):
    rows = [(i, f"top {i}\nBoiler  \n\nunique {i}\n boiler", "a") for i in range(12)] + [(100 + i, "Boiler\nx", "b") for i in range(5)] + [(200, None, "a"), (201, "", "a"), (202, "Boiler", None), (0, "top 0\nBoiler", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, n_lines string")
    got = Counter(tuple(r) for r in line_dedup.line_dedup(df, 0.5, 10).select("doc_id", "text", "source", "n_lines", "n_dropped").collect())
    sizes, pages = Counter(r[2] for r in rows), Counter()
    for _, t, s in rows:
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            pages[s, line] += 1
    want = Counter()
    for d, t, s in rows:
        if t is None:
            want[d, None, s, 0, 0] += 1
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip(" \t\r") or not (pages[s, x.strip(" \t\r")] >= 10 and pages[s, x.strip(" \t\r")] > sizes[s] * 0.5)]
        want[d, "\n".join(kept), s, len(lines), len(lines) - len(kept)] += 1
    assert got == want
    assert line_dedup.line_dedup(empty).collect() == []


def test_line_dedup_small_sites(spark):
    rows = [(i, f"menu\nhalf {i % 2}\nown {i}", "a") for i in range(9)] + [(10 + i, f"menu\nx {i}", "b") for i in range(2)] + [(20 + i, f"{'menu' if i < 9 else i}\ny {i}", "c") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    got = {r.doc_id: r.text for r in stage(spark, df, "").collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if not (s == "a" and x in ("menu", "half 0"))) for d, t, s in rows}


def test_pipeline_keeps_one_of_many_copies(spark):
    copy = "\n".join(f"line {i} of the copied text" for i in range(4))
    rows = [(i, copy, "a") for i in range(30)] + [(100 + i, "menu\n" + " ".join(f"w{i}x{j}" for j in range(9)), "a") for i in range(80)] + [(300, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)
    lines = stage["line_dedup"](spark, df, "")
    got = {r.doc_id: r.text for r in lines.collect()}
    assert [got[i] for i in range(30)] == [copy] * 30 and got[300] is None
    assert not any(got[100 + i].startswith("menu") for i in range(80))
    assert [r.doc_id for r in stage["near_dedup"](spark, lines, "").collect() if r.text == copy] == [0]


def test_line_dedup_without_broadcast(docs, monkeypatch):
    want = sorted(map(str, line_dedup.line_dedup(docs, 0.1, 2).select("doc_id", "text").collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(map(str, line_dedup.line_dedup(docs, 0.1, 2).select("doc_id", "text").collect())) == want


def brute_decontam(docs, bench):
    windows = defaultdict(set)
    for item, text in bench.collect():
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        w, hit, items = ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found is not None:
                    hit |= set(range(i, i + n))
                    items |= {str(x) for x in found if x is not None}
        out[d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("limit", [200_000, -1])
def test_decontamination(docs, bench, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    got = Counter(tuple(r) for r in decontam.report(docs, bench).drop("items").collect())
    assert got == brute_decontam(docs, bench)


def test_decontamination_empty_sides(docs, empty, bench):
    assert decontam.report(empty, bench).collect() == []
    none = decontam.report(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in brute_decontam(docs, bench).items() if not k[-1])


def shingles(text):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets if d is not None}


def test_minhash(docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = minhash.classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.classes(empty).collect() == []
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}


def test_deduplicate_rows_without_an_id_of_their_own(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(7, one), (7, one), (None, one), (9, one + " end"), (None, two), (None, two), (3, three), (3, two + " end"), (None, ""), (None, None), (5, three)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in minhash.deduplicate(df).collect())
    assert got == Counter([(7, one), (3, two + " end"), (3, three), (None, ""), (None, None)])


def test_minhash_large_mixed_buckets(spark, monkeypatch):
    """Buckets past the all-pairs size go through blocks and lose no link."""
    import random

    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng, rows = random.Random(8), []
    common = [f"c{j}" for j in range(40)]
    for g in range(6):
        own = [f"g{g}w{j}" for j in range(20)]
        for k in range(5):
            w = common + own
            w[rng.randrange(len(w))] = f"edit{g}{k}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.classes(df, rows=2, bands=60).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    s = minhash.sketch([a, b, a[:1], np.zeros(0, np.uint64)], 360)
    assert (s[:3] != minhash.EMPTY).all() and (s[3] == minhash.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in components.components(Scratch(spark, "cc"), df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    more = spark.createDataFrame([(40, 101)], "a long, b long")
    seed = spark.createDataFrame(list(got.items()), "node long, comp long")
    again = {r.node: r.comp for r in components.components(Scratch(spark, "cc"), more, seed=seed).collect()}
    assert set(again.values()) == {0} and len(again) == 45


def test_word_hashes():
    texts = ["a bc  a", None, "", "bc\ta\n", "x" * 3000 + " a"]
    found = words.words_of(pa.array(texts))
    flat = [w for t in texts for w in SPACE.findall(t or "")]
    assert len(found.hash) == len(flat)
    by = defaultdict(set)
    for w, h in zip(flat, found.hash, strict=True):
        by[w].add(h)
    assert all(len(s) == 1 for s in by.values()) and len(set().union(*by.values())) == len(by)
    assert np.diff(found.first).tolist() == [len(SPACE.findall(t or "")) for t in texts]


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    texts = [("ab cd-ef " * 40).strip(), "", None, "x" * 700, "gh", "ij kl", " ", "mn" + "y" * 90]
    whole = words.words_of(pa.array(texts), words.LETTERS, lower=True, prefixes=(4, 6))
    cut = words.segments
    monkeypatch.setattr(words, "segments", lambda data, inside: cut(data, inside, 64))
    parts = words.words_of(pa.array(texts), words.LETTERS, lower=True, prefixes=(4, 6))
    for name in ("start", "end", "hash", "first", "prefix"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


def test_toxicity_scores_do_not_depend_on_spans(monkeypatch):
    rows = toxic_rows(300, 3)
    model = toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows])
    texts = pa.array([r[1] for r in rows[:40]] + [None, "", "w1", " ".join(r[1] for r in rows[:60])])
    whole, cut = model.score(texts), toxicity.spans_of
    monkeypatch.setattr(toxicity, "spans_of", lambda first: cut(first, 17))
    assert np.allclose(whole, model.score(texts), atol=1e-6)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the sample tables")
def test_toxicity_on_the_sample_tables_by_language(spark):
    """Held-out rows of invented prose, where toxic words share no stem."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels.filter("toxic is not null").select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    by = defaultdict(list)
    for r in scored:
        by[r.lang].append(r)
        by["all"].append(r)
    for lang, rows in by.items():
        good, bad = np.array([r.score for r in rows if r.toxic]), np.array([r.score for r in rows if not r.toxic])
        if len(good) < 20:
            continue
        auc = (good[:, None] > bad[None, :]).mean()
        assert auc > 0.9, (lang, auc)
        assert lang != "all" or ((good >= 0.7).mean() > 0.8 and (bad >= 0.7).mean() < 0.01), ((good >= 0.7).mean(), (bad >= 0.7).mean())


def toxic_rows(n, seed):
    import random

    rng, rows = random.Random(seed), []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "vile" + rng.choice(["", "ness", "ish", "r"])
        rows.append((i, " ".join(w), toxic, "en" if i % 2 else "fr"))
    return rows


def test_toxicity_held_out(spark, docs, empty):
    rows = toxic_rows(1500, 1)
    df = spark.createDataFrame([r[:2] + r[3:] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    truth = {r[0]: r[2] for r in rows}
    out = toxicity.score(df, model).collect()
    held = [(r.score, truth[r.doc_id], r.predicted) for r in out if r.held_out]
    assert {r.doc_id for r in out if r.held_out} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([g > b for g in good for b in bad])
    assert auc > 0.97 and np.mean([p == y for _, y, p in held]) > 0.95
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty, model).collect() == []
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in odd)


def test_toxicity_without_labels(docs):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
