"""Joins, archives, packing, token files and encodings of documents."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_distinct, chosen_path, components, packing_gga, queries, vbyte_ids, warc_revisit, wordsplit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, sig string, n long, ids string, score double"
LONG = "word " * 300_000 + "end"
ROWS = [
    (1, "a b c d e f g h"), (2, None), (3, ""), (4, " \n\t"), (5, "it's we'll 12 'tis <|endoftext|> !!"), (6, LONG), (None, "a b c d e f g h"),
    (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "one two"), (9, "One  two"), (10, "x" * 3000), (11, "日本語 é \U0001f600  \u0085 z"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", 1, "i", 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_follow_the_pattern():
    import random

    import regex

    rng = random.Random(1)
    signs = [*"ab  \n\t'''srtvemld19!.é中　 \u0085", "'s", "'re", "<|endoftext|>", " \U0001f600"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)]
    joined, starts, ends, _ = wordsplit.pieces(texts)
    assert [joined[a:b] for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]
    cut = list(wordsplit.safe_cuts("ab  cd " * 100, 50))
    assert "".join(cut) == "ab  cd " * 100 and len(cut) > 5


def test_hash_table_and_coder_limits():
    rng = np.random.default_rng(0)
    table_, known = wordsplit.HashTable(4), {}
    for _ in range(30):
        keys = np.unique(rng.integers(0, 5000, 200, dtype=np.uint64) * np.uint64(1 << 50))
        found_ = table_.find(keys)
        assert [known.get(k, -1) for k in keys.tolist()] == found_.tolist()
        new = keys[found_ < 0]
        table_.add(new, np.arange(len(known), len(known) + len(new)))
        known |= dict(zip(new.tolist(), range(len(known), len(known) + len(new)), strict=True))
    calls = []
    coder = wordsplit.PieceCoder(lambda words: calls.append(words) or [[len(w)] * 2 for w in words], limit=3)
    texts = ["a bb ccc", "a bb", "", "dddd a"] * 3
    for _ in range(2):
        got = {k: ids.tolist() for k, ids in coder.ids(texts)}
        assert got == {k: [n for w in t.split(" ") if w for n in [len(w) + (not t.startswith(w))] * 2] for k, t in enumerate(texts)}
    assert len(calls) == 2  # the table was emptied in between


def test_words_whose_hashes_agree(monkeypatch):
    """All hashes are alike, so every word but the first is told apart by its check."""
    real = wordsplit.pieces

    def alike(parts):
        joined, starts, ends, hashes = real(parts)
        return joined, starts, ends, np.full_like(hashes, 7)

    monkeypatch.setattr(wordsplit, "pieces", alike)
    monkeypatch.setattr(bpe_distinct, "pieces", alike)
    words = ["one", "two", "three", "one", "x" * 300, "two"]
    coder = wordsplit.PieceCoder(lambda found: [[len(w), ord(w[0])] for w in found])
    assert [next(coder.ids([w]))[1].tolist() for w in words] == [[len(w), ord(w[0])] for w in words]
    block = bpe_distinct._Block()
    for k, w in enumerate(words):
        block.add([k], [w])
    assert [block.words[s[0]] for s in block.stream] == words and len(block.words) == 4
    spans = np.array([0, 3, 6]), np.array([3, 6, 9])
    a, b, c = wordsplit.span_checks(wordsplit.code_points("abcabcabd"), *spans)
    assert a == b != c


# Chosen-path join


def brute(rows, threshold=0.8, n=5):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    links, root = Counter(), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ok = [bool(s) and rows[k][0] is not None for k, s in enumerate(sets)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        if ok[k]:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return Counter((r[0], low[find(k)] if ok[k] else r[0], links[k]) for k, r in enumerate(rows))


def found(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_join_odd_rows(spark):
    assert found(chosen_path.ngram_jaccard_join(table(spark))) == brute(ROWS)
    assert chosen_path.ngram_jaccard_join(table(spark, [])).count() == 0


def test_join_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 80)]
    rows = []
    for k in range(150):
        own = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 3)):
            own[at] = f"v{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60))) for k in range(30)]
    got, want = found(chosen_path.ngram_jaccard_join(table(spark, rows), small=20)), brute(rows)
    assert {(d, c) for d, c, _ in got} == {(d, c) for d, c, _ in want}
    assert sum(n for *_, n in got.elements()) >= 0.97 * sum(n for *_, n in want.elements())
    links = {d: n for d, _, n in want}
    assert all(n <= links[d] for d, _, n in got)


def test_join_two_tight_clusters(spark):
    """Both clusters share most nodes with the same members, and each node has to be split on its own."""
    rng = np.random.default_rng(0)
    one = [f"w{x}" for x in rng.integers(0, 10**6, 1200)]
    two = one[:1080] + [f"x{x}" for x in rng.integers(0, 10**6, 120)]
    rows = [(50 * j + k, " ".join([*words, f"n{k}{j}"])) for j, words in enumerate((one, two)) for k in range(50)]
    assert found(chosen_path.ngram_jaccard_join(table(spark, rows))) == brute(rows) == Counter({(k, 0, 99): 1 for k in range(100)})


def test_join_in_blocks():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.95], rng.integers(0, 2**62, 3, dtype=np.uint64)])) for _ in range(40)]
    nodes = [{5} | ({2} if k % 3 == 0 else set()) for k in range(40)]
    want = {
        (a, b) for a in range(40) for b in range(a + 1, 40)
        if not (a % 3 == 0 and b % 3 == 0) and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    }
    assert want and set(chosen_path.similar_pairs(sets, nodes, 5, np.zeros(40, bool), True, 0.8)) == want
    half = np.arange(40) < 20
    assert set(chosen_path.similar_pairs(sets, nodes, 5, half, False, 0.8)) == {(a, b) for a, b in want if half[a] != half[b]}


def test_keep_one(spark):
    kept = chosen_path.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, None, 8, 10, 11])


@pytest.mark.parametrize("heavy", [400, 1])
def test_keep_one_decides_by_text(spark, monkeypatch, heavy):
    monkeypatch.setattr(chosen_path, "HEAVY", heavy, raising=False)
    a, b, c = "a b c d e f g h", "one two three four five six", "p q r s t u v w x y z"
    near = " ".join(f"w{k}" for k in range(100))
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (6, c), (6, c), (7, "q"), (7, "r"), (7, "r"), (8, "")] + [(8, "")] * 2 + [(9, None), (9, None), (None, a), (None, a)]
    rows += [(20, near), (20, near + " end"), (20, near + " end"), (21, near), (22, near.upper())]
    kept = Counter((r.doc_id, r.text) for r in chosen_path.keep_one(table(spark, rows)).collect())
    least = {n for d, n in kept if d == 20}
    assert len(least) == 1 and least < {near, near + " end"}
    want = [(1, a), (5, b), (6, c), (7, "q"), (7, "r"), (8, ""), (9, None), (None, a), (None, a), (20, *least)]
    assert kept == Counter(want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (7, None)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100} | {200 + k: 200 for k in range(1, 50)}


# Archives


def test_archives(spark, tmp_path):
    big, other = "x" * 1000, "y" * 999
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (9, "u9", big), (9, "again", big), (3, None, other), (4, "u4", other), (5, "u5", None), (None, "un", big), (6, "u6", "é\r\n\r\nWARC/1.1\r\n" * 80)]
    pages = spark.createDataFrame([(*r, "k", 3) for r in rows], "page_id long, url string, html string, key string, digest int")
    path = warc_revisit.write_archives(pages, str(tmp_path / "warc"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_revisit.read_archives(spark, path).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        group = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        first = max(group, default=None) if len(raw) >= 1000 and len([1 for r in rows if r[2] == h]) > 1 else None
        refers = first if first is not None and i != first else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert got == want
    text = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert text.count(big.encode()) == 2 and b"WARC-Target-URI: u2%0D%0AX: y\r\n" in text
    empty = warc_revisit.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc_revisit.read_archives(spark, empty).count() == 0


def explained(df):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_revisit, "FILE_BYTES", 100_000)
    long = "z" * (24 << 20)
    rows = [(k, f"u{k}", "small " * 30) for k in range(400)] + [(500, "l", long), (501, "l", long), (502, "m", long + "y")] + [(600, "t", "tie " * 300)] * 3 + [(599, "t", "tie " * 300)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc_revisit.write_archives(pages, str(tmp_path / "warc"), staged_buckets=2)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "warc").glob("part-*"))
    assert len(sizes) > 5 and [n for n in sizes if n > 101_000] == sizes[-2:]  # each long one alone, the copy without payload
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc_revisit.read_archives(spark, path).collect())
    want = Counter([(k, "response", None) for k in range(400)] + [(500, "revisit", 501), (501, "response", None), (502, "response", None)])
    assert got == want + Counter([(600, "response", None)] * 3 + [(599, "revisit", 600)] * 2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_pages")]


def test_no_payload_is_shuffled(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    staged = warc_revisit.stage(pages, "staged_pages", str(tmp_path / "staged"))
    try:
        with warc_revisit._conf(spark, spark_sql_autoBroadcastJoinThreshold="-1", spark_sql_requireAllClusterKeysForCoPartition="false"):
            plan = explained(warc_revisit.records(warc_revisit.resolve(staged)))
    finally:
        spark.sql("DROP TABLE staged_pages")
    moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and part.startswith("(")]
    assert moved and not [part for part in moved if "payload#" in part]
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan


# Packing


def check_packing(rows, ids, capacity=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            assert r.piece == 0 or r.length == capacity
            at += r.length
        assert at == len(ids[d])
    return len(by_seq)


def test_packing(spark, hf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: [*hf(r.text), 2] for r in docs.collect()}
    n = check_packing(queries.op4_best_fit_packing(spark, SF).collect(), ids)
    least = -(-sum(map(len, ids.values())) // 1024)
    assert least <= n <= least * 1.02 + 1


def test_packing_odd_rows(spark, hf):
    rows = [r for r in ROWS if r[0] not in (7, None)]
    got = packing_gga.best_fit_packing(table(spark, rows), with_ids=True, cell_items=4).collect()
    check_packing(got, {d: [*hf(t), 2] for d, t in rows})
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing_gga.best_fit_packing(table(spark)).where("doc_id = 7 or doc_id is null").count() == 3
    assert packing_gga.best_fit_packing(table(spark, [])).count() == 0


def test_genetic_search_finds_perfect_packings():
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(60):  # bins that are exactly full
        cut = np.sort(rng.choice(np.arange(1, 1024), 2, replace=False))
        sizes += np.diff([0, *cut, 1024]).tolist()
    sizes = np.array(sizes, np.int32)
    greedy = packing_gga.by_order(sizes.tolist(), 1024, np.argsort(-sizes, kind="stable").tolist())
    found_ = packing_gga.evolve(sizes, 1024, 1, 30, [])
    assert 60 <= len(found_.bins) <= len(greedy.bins) <= 63
    labels = found_.labels()
    assert np.bincount(labels, sizes).max() <= 1024
    child = packing_gga.crossover(greedy, found_, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(len(sizes)))


# Token files


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = vbyte_ids.encode_ranks(ranks)
        assert (vbyte_ids.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files(spark, hf, tmp_path, monkeypatch):
    monkeypatch.setattr(vbyte_ids, "FILE_IDS", 500)
    path = vbyte_ids.write_token_files(table(spark), str(tmp_path / "t"))
    got = vbyte_ids.token_index(spark, path).orderBy("start").collect()
    want = sorted(((d, [*hf(t), 2]) for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for g, (d, ids) in zip(got, want, strict=True):
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    read = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in vbyte_ids.read_token_files(spark, path).collect()}
    assert read == dict(want)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [(-r.n, r.id) for r in ranks] == sorted((-r.n, r.id) for r in ranks)
    empty = vbyte_ids.write_token_files(table(spark, []), str(tmp_path / "e"))
    assert vbyte_ids.token_index(spark, empty).count() == 0


def test_ids_of_more_than_16_bits(spark, tmp_path):
    """A vocabulary of 70,000 words, most of whose ids need a third byte."""
    import json

    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(70_000)]
    vocab = tmp_path / "words.json"
    model = {"type": "WordLevel", "vocab": {w: k for k, w in enumerate(words)}, "unk_token": words[0]}
    vocab.write_text(json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None, "model": model, "truncation": None, "padding": None}))
    assert vbyte_ids.largest_id(str(vocab), 2) == 69_999 and vbyte_ids.id_type(69_999) == "<u4" and vbyte_ids.id_type(65_535) == "<u2"
    with pytest.raises(ValueError):
        vbyte_ids.largest_id(str(vocab), 1 << 32)
    coder = Tokenizer.from_file(str(vocab))
    rows = [(k, words[k * 7]) for k in range(9000)] + [(5, words[69_999]), (None, words[65_536])]
    path = vbyte_ids.write_token_files(table(spark, rows), str(tmp_path / "t"), vocab=str(vocab), end_id=69_998)
    want = sorted(((d, [*coder.encode(t, add_special_tokens=False).ids, 69_998]) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in vbyte_ids.read_token_files(spark, path).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == want and max(max(x) for _, x in want) == 69_999


def test_an_id_of_many_rows_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vbyte_ids, "FILE_IDS", 3000)
    rows = [(k, "a b c") for k in range(300)] + [(150, f"hot row {k}") for k in range(6000)]
    path = vbyte_ids.write_token_files(table(spark, rows), str(tmp_path / "t"))
    ids = sorted(r.start for r in vbyte_ids.token_index(spark, path).collect())
    index = sorted((r.start, r.n_tokens, r.doc_id) for r in vbyte_ids.token_index(spark, path).collect())
    assert [a for a, *_ in index] == [0, *np.cumsum([n for _, n, _ in index])[:-1].tolist()] and ids[0] == 0
    assert [d for *_, d in index] == sorted(d for d, _ in rows)
    per_task = Counter(p.name.split("-")[1] for p in (tmp_path / "t/files").glob("part-*"))
    assert len(per_task) == 4 and max(per_task.values()) <= 2 * min(per_task.values())  # 95 % of the rows have one id


def test_prefix_sums(spark):
    from tidemark.llm.prefix import prefix_sums

    rows = [(k, (k * 37) % 11) for k in range(500)]
    got = {r.k: r.s for r in prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", "v", "s").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    assert prefix_sums(spark.createDataFrame([], "k long, v long"), "k", "v", "s").count() == 0


# Distinct-word BPE


def test_distinct_word_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_distinct.digest(table(spark), block_chars=2_000_000).collect())
    want = Counter()
    for d, t in ROWS:
        ids = coder.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe_distinct.decode(bpe_distinct.encode(table(spark))).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter((d, t or "") for d, t in ROWS)
    assert bpe_distinct.encode(table(spark, [])).count() == 0


def test_words_and_blocks_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(bpe_distinct, "KNOWN_WORDS", 50)
    rows = [(k, " ".join(f"word{(k * 31 + j) % 3000}" for j in range(200))) for k in range(400)]
    docs = table(spark, rows).repartition(6)
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe_distinct.decode(bpe_distinct.encode(docs, block_chars=20_000)).collect()}
    assert got == dict(rows)
    plan = explained(bpe_distinct.encode(docs, block_chars=20_000))
    assert plan.count("REPARTITION_BY_NUM") >= 2
