"""Operators on Spark: edge cases, brute force, recoveries of order and structure."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from citeweave.llm import chunk_dedup, cover_tree, hilbert, jaccard_join, media, mixing, packing, quality, secrets, toxicity
from citeweave.llm.registry import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"
BASE = " ".join(f"word{i} alpha{i % 7}" for i in range(80))
ROWS = [
    (1, BASE, "en", "a", 10, "k", 1), (2, BASE, "en", "b", 10, None, 2), (2, BASE, "en", "b", 10, None, 2), (3, BASE + " tail", "fr", None, 11, "k", None), (4, None, None, "a", None, "k", 3), (5, "", "en", "a", 0, "", 0),
    (6, " \n\t", "en", "a", 3, "k", 1), (7, "token = abcdef123", "en", "", 1, "k", 1), (None, "no key here", "en", "a", 1, "k", 1), (8, "é" * 40_000 + " " + BASE, "de", "c", 1, "k", 1), (9, "short one", "en", "c", 1, "k", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def test_media(spark, docs, none, texts):
    got = media.media_digest(docs).collect()
    assert len(got) == len(ROWS) and media.media_digest(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[4].payload_sha256 == by[5].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and by[1].media_sha256 == by[2].media_sha256
    for r in QUERIES["op1_media_flac"](spark, SF).collect():
        raw = media.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    blocks = media.pcm_blocks(media.encode_media(docs.filter("doc_id = 8"))).orderBy("block").collect()
    assert [b.first_sample for b in blocks] == [512 * i for i in range(len(blocks))]


def test_sharding(spark, docs, none):
    assert hilbert.shard_by_curve(none).count() == 0
    for got in (hilbert.shard_by_curve(docs).collect(), QUERIES["op5_sharding_hilbert"](spark, SF).collect()):
        counts = Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        order = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
    by = {r.doc_id: r for r in hilbert.shard_by_curve(docs).collect()}
    assert (by[4].size, by[4].text_crc32, by[8].size, by[7].text_crc32) == (1, 0, 80_000 + 2 + len(BASE), zlib.crc32(b"token = abcdef123"))
    shards = hilbert.shard_by_curve(docs)
    hit = {r.shard for r in hilbert.prune(hilbert.run_ranges(shards, ["size"]), size=(80_000, 10**9)).collect()}
    assert {r.shard for r in shards.filter("size > 80000").collect()} <= hit


def test_equal_texts_lie_side_by_side(spark, docs, monkeypatch):
    """A group is one piece of the order whatever its members' metadata; the place of every row follows from its definition."""
    monkeypatch.setattr(hilbert, "HEAVY", 20)  # of 161 rows, groups of eight are heavy
    rows = [(i, f"text {i % 40 if i % 3 else 0}", "en" if i % 2 else "fr", f"s{i % 5}") for i in range(160)] + [(160, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = frame.withColumn("size", F.lit(1)).withColumn("rank", F.lit("r")).withColumn("shard", F.lit(0)).withColumn("members", F.lit(0))
    for got in (hilbert.shard_by_curve(frame).collect(), hilbert.shard_by_curve(extra).collect()):
        assert len(got) == len(rows)
        text = {r[0]: r[1] for r in rows}
        order = [text[r.doc_id] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == len(set(order)) - 1
        assert len({r.curve_index for r in got if text[r.doc_id] == "text 0"}) == 1
    counts = defaultdict(set)
    for r in hilbert.shard_by_curve(docs).collect():
        counts[r.text_crc32, r.size].add(r.curve_index)
    assert all(len(v) == 1 for k, v in counts.items() if k != (0, 1))  # null and empty texts are told apart


def test_secrets(spark, docs, none, texts):
    assert secrets.secret_spans(none).count() == 0 and secrets.secret_spans(docs).count() == len(ROWS)
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[7].text == "[secret]" and clean[7].n_chars == 8 and clean[4].text is None and clean[4].n_chars is None and clean[1].text == BASE
    for r in QUERIES["op7_secret_scans"](spark, SF).collect():
        spans = secrets.base_spans(texts[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.n_hex == sum(k == 2 for _, k, _ in spans)


def check_packing(got, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_vocabulary()[0])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, rows in pieces.items():
        ids = np.array([*coder.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.start for r in rows] == [s for s, _ in packing.cut(len(ids))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(bins), sum(r.length for r in got)


def test_packing(spark, docs, none, texts):
    assert packing.pack_documents(none).count() == 0
    bins, total = check_packing(QUERIES["op8_best_fit_packing"](spark, SF).collect(), texts)
    assert bins <= -(-total // 2048) + 2
    rows = packing.pack_documents(docs.filter("doc_id <> 2 and doc_id is not null")).collect()
    check_packing(rows, {r[0]: r[1] for r in ROWS if r[0] not in (2, None)})
    tree = packing.pack_pieces(packing.token_pieces(spark.read.parquet(f"{SF}/documents.parquet")), items_per_task=40).collect()
    assert check_packing(tree, texts)[0] <= bins * 1.1 + 3


def test_mixing(spark, docs, none, texts):
    assert mixing.taken_words(none).count() == 0
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = mixing.taken_words(frame).collect()
        assert len(got) == frame.count()
        size = {(r.doc_id, r.text): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in frame.collect()}
        assert Counter(r.size for r in got) == Counter(size[(r.doc_id, r.text)] for r in frame.collect())
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        taken = Counter()
        for r in got:
            taken[(r.source_size, r.target)] += r.taken
        by_target = Counter((r.source_size, r.target) for r in {(r.source_size, r.target): r for r in got}.values())
        assert by_target
    full = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in full.collect()}
    sums, goal = Counter(), {}
    for r in mixing.taken_words(full).collect():
        sums[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(abs(sums[s] - goal[s]) <= 0.5 + 1e-9 for s in goal)
    again = {r.doc_id: r.taken for r in mixing.taken_words(full.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in mixing.taken_words(full).collect()}
    mixed = {r.doc_id: len((r.text or "").split()) for r in mixing.mixed_documents(full).collect()}
    assert mixed == {d: n for d, n in again.items() if n}


def test_mixed_rows_keep_what_was_drawn_of_them(spark, docs, none):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mixed_documents(none).count() == 0
    got, want = Counter(), Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id, words(r.text)] += 1
    for r in mixing.taken_words(docs).collect():
        if r.taken:
            want[r.doc_id, r.taken] += 1
    assert got == want and any(d is None for d, _ in got)


def test_mixed_texts_are_stretches_of_the_texts(spark):
    """Line breaks stay, names may clash, null and repeated keys keep their own words, and a text taken whole once is untouched."""
    code = "def f():\n    return 1\n\n"
    long = "\n".join(f"w{i}\t x{i}" for i in range(3000))
    texts = [(1, code), (None, "no key\nat all"), (2, "one text\nof two"), (2, "another\r\ntext"), (2, "another\r\ntext"), (3, long), (4, None), (5, " \n"), (None, "  second\nwithout key ")]
    rows = [(d, t, s, "x", i, [i], "y") for s in ("a", "b", None) for i, (d, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _w string, _o int, _taken array<int>, row string").withColumn("size", F.lit(7)).withColumn("taken", F.lit("z")).withColumn("src", F.lit(1)).withColumn("row_id", F.lit(2.5))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    whole, parts, got = 0, 0, mixed.collect()
    for r in got:
        source = texts[r._o][1]
        assert r._taken == [r._o] and (r._w, r.row, r.size, r.taken, r.src, r.row_id) == ("x", "y", 7, "z", 1, 2.5)
        left = r.text
        if left == source:
            whole += 1
            continue
        parts += 1
        words = word.findall(source)
        while left:  # every line but those of the text itself begins a stretch
            first = words.index(word.search(left)[0])
            at = next(m.start() for i, m in enumerate(word.finditer(source)) if i == first)
            n = max(len(x) for x in [source[at : at + k] for k in range(1, len(source) - at + 1)] if left.startswith(x)) if len(source) < 200 else len(os.path.commonprefix([left, source[at:]]))
            left = left[n:].lstrip("\n")
    assert whole and parts and max(Counter(r.doc_id for r in got).values()) > 1
    want = Counter((r.doc_id, r.taken) for r in mixing.taken_words(frame).collect() if r.taken)
    assert Counter((r.doc_id, len(word.findall(r.text))) for r in got) == want


def test_mixing_reruns_agree_on_repeated_keys(spark):
    rows = [(i % 3, f"{'t' * (i % 5 + 1)} " * (400 * (i % 7 + 1)), "a") for i in range(60)]
    runs = []
    for parts in (1, 5, 3):
        frame = spark.createDataFrame(rows[::-1] if parts == 5 else rows, "doc_id long, text string, source string").repartition(parts)
        runs.append(sorted((r.doc_id, r.text) for r in mixing.mixed_documents(frame).collect()))
    assert runs[0] == runs[1] == runs[2]


def brute_components(texts, size, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_texts():
    """Chains and clouds of near copies, short sets around the boundary, shared passages."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = {}
    for base_size in (9, 11, 13, 16, 20, 24, 45, 120):
        base = [word() for _ in range(base_size)]
        for c in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + base_size // 14)):
                w[rng.randrange(len(w))] = word()
            if c % 3 == 2:
                w = w[: len(w) - rng.randrange(0, 2)]
            out[len(out)] = " ".join(w)
    passage = " ".join(word() for _ in range(40))
    for _ in range(12):
        out[len(out)] = " ".join(word() for _ in range(30)) + " " + passage
    step = [word() for _ in range(80)]
    for i in range(12):
        step = [*step[2:], word(), word()]
        out[len(out)] = " ".join(step)
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, none, size, percent):
    texts = near_texts()
    frame = spark.createDataFrame([*texts.items(), (900, None), (901, ""), (902, texts[3]), (902, texts[3])], "doc_id long, text string")
    texts |= {900: None, 901: "", 902: texts[3]}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(frame, size, percent).collect()}
    assert got == brute_components(texts, size, percent)
    assert jaccard_join.linked_components(none, size, percent).count() == 0


def test_jaccard_join_splits_long_lists(spark, monkeypatch):
    """A cloud of texts just below the threshold of each other, with lists, clusters and shingles cut into many parts."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(100)], {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice((1, 2, 2, 3))):
            w[rng.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    met = []
    real = jaccard_join._in_groups
    monkeypatch.setattr(jaccard_join, "_in_groups", lambda rows, *rest: met.append(rows.count()) or real(rows, *rest))
    for name, value in (("LIST_PART", 2), ("CLUSTER_PART", 3), ("SMALL_CLUSTER", 4), ("HOT_SHARE", 500)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(frame).collect()}
    assert got == brute_components(texts, 3, 90) and 1 < len({c for _, c in got.values()}) < 60
    assert len(met) == 2 and min(met) > 500


def test_jaccard_edges(spark, docs, texts):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked_components(docs).collect()), key=str)
    by = {d: (n, c) for d, n, c in got}
    assert by[2][1] == by[3][1] == 1 and by[4] == (0, 4) and by[5] == (0, 5) and by[9] == (1, 9) and by[None][1] is None
    full = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_ngram_jaccard_join"](spark, SF).collect()}
    assert full == brute_components(texts, 3, 90)
    assert {r.doc_id for r in jaccard_join.keep_one_per_group(docs).collect()} == {1, 4, 5, 6, 7, None, 9}


def test_rows_that_share_a_key_are_documents(spark):
    """Repeated keys with unrelated, linked and equal texts; names that clash with the operator's own."""
    texts = list(near_texts().values())
    one, two, three = texts[40], texts[50], texts[60]
    rows = [(7, one), (7, two), (7, three), (7, one), (3, two + " tail"), (9, three), (9, ""), (9, ""), (9, None), (None, one), (None, one), (11, texts[70]), (12, texts[70])] + [(-5, t) for t in texts[:9]]
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, i int").withColumn("node", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("component", F.lit(None).cast("int")).withColumn("copies", F.col("i"))
    number = {i: t for i, (d, t) in enumerate(rows) if d is not None}
    want = brute_components(number, 3, 90)
    group = lambda i: {j for j in number if want[j][1] == want[i][1]}
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked_components(frame).collect())
    expected = Counter((rows[i][0], want[i][0], min(rows[j][0] for j in group(i)) if want[i][0] else rows[i][0]) for i in number)
    assert got == expected + Counter({(None, want[0][0], None): 2})
    kept = jaccard_join.keep_one_per_group(frame)
    assert kept.columns == frame.columns
    kept = kept.collect()
    assert all((r.node, r.rep, r.text_hash, r.component, r.copies) == ("x", 1, 2, None, r.i) for r in kept)
    assert Counter(want[r.i][1] for r in kept if r.doc_id is not None and want[r.i][0]) == Counter({want[i][1]: 1 for i in number if want[i][0]})
    assert all(r.doc_id == min(rows[j][0] for j in group(r.i)) for r in kept if r.doc_id is not None)
    assert Counter((r.doc_id, r.text) for r in kept if not r.text or r.doc_id is None) == Counter({(9, ""): 1, (9, None): 1, (None, one): 2})


def test_top_k(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op6_exact_topk"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op6_exact_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want
    bad = float("nan")
    rows = [(0, [0.5, 0.5]), (100, [0.5, 0.5]), (1, None), (2, [0.1, None]), (3, [bad, 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (6, [-0.001, 0.0]), (7, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in cover_tree.top_k(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 2 * 512**2), (0, 2, 100, 2 * 512**2), (0, 3, 6, -2 * 512), (100, 1, 0, 2 * 512**2), (100, 2, 5, 2 * 512**2), (100, 3, 6, -2 * 512)]
    assert cover_tree.top_k(frame.limit(0)).count() == 0


def test_substrings(spark, docs, none):
    assert chunk_dedup.repeated_spans(none).count() == 0
    got = chunk_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 8} and {r.first_doc_id for r in got} == {1} and {r.doc_id for r in got if r.kept} == {1}
    import random

    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [fresh(60) for _ in range(20)]
    rows = [(i, fresh(rng.randrange(30, 90)) + " " + passages[i % 20] + " " + fresh(40)) for i in range(60)] + [(100 + i, fresh(120)) for i in range(30)]
    found = {r.doc_id for r in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(60))


def test_copies_behind_a_common_line_keep_one_body(spark):
    import random

    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    line, body = fresh(40), fresh(200)
    texts = {1: line + " " + fresh(50), 5: line + " " + body, 9: line + " " + body}
    got = chunk_dedup.repeated_spans(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id, r.kept) for r in got} == {(1, 1, True), (5, 1, False), (5, 5, True), (9, 1, False), (9, 5, False)}
    left = {d: bytearray(t.encode()) for d, t in texts.items()}
    for r in sorted(got, key=lambda r: -r.start):
        if not r.kept:
            del left[r.doc_id][r.start : r.end]
    assert body[40:-40] in left[5].decode() and not left[9] and line[:-40] in left[1].decode()


def chunks_by_definition(raw):
    """The chunk rule byte by byte: the gear hash of the last bytes, the least distance, and the cuts of long gaps."""
    gear, width, least, most = [int(x) for x in chunk_dedup.GEAR], chunk_dedup.WINDOW, chunk_dedup.LEAST, chunk_dedup.MOST
    h = [sum(gear[raw[p - i]] << i for i in range(min(width, p + 1))) & 0xFFFFFFFF for p in range(len(raw))]
    places = [p + 1 for p in range(len(raw)) if p + 1 >= width and h[p] < (1 << 32) // chunk_dedup.MEAN]
    cuts = [p for i, p in enumerate(places) if i == 0 or p - places[i - 1] >= least]
    marks, out = [0, *cuts, len(raw)], set(cuts) | {len(raw)}
    for at, stop in zip(marks, marks[1:], strict=False):
        while stop - at > most:
            window = h[at + most // 4 : at + most // 2]
            at += most // 4 + window.index(min(window)) + 1
            out.add(at)
    return sorted(out)


def repeats_by_definition(texts, min_words, passage_words):
    """Rows of repeated_spans, from chunks held as bytes."""
    cuts, holders = {}, defaultdict(list)
    for d, t in texts.items():
        ends = chunks_by_definition(t) if t else []
        cuts[d] = list(zip([0, *ends], ends, strict=False))
        for a, b in cuts[d]:
            holders[t[a:b]].append(d)
    out = set()
    for d, t in texts.items():
        white = lambda i: i < 0 or t[i] in b" \t\n\v\f\r"  # noqa: B023,E731
        words = [sum(white(i - 1) and not white(i) if i else not white(i) for i in range(a, b)) for a, b in cuts[d]]
        shared = [min(holders[t[a:b]]) < max(holders[t[a:b]]) for a, b in cuts[d]]
        i = 0
        while i < len(shared):
            j = i
            while j < len(shared) and shared[j]:
                j += 1
            around = (words[i - 1] if i else 0) + (words[j] if j < len(words) else 0)
            if j > i and sum(words[i:j]) >= min_words and sum(words[i:j]) + around >= passage_words:
                first = [min(holders[t[a:b]]) for a, b in cuts[d]]
                k = i
                while k < j:
                    m = k
                    while m < j and first[m] == first[k]:
                        m += 1
                    out.add((d, cuts[d][k][0], cuts[d][m - 1][1], sum(words[k:m]), m - k, first[k], min(len(holders[t[a:b]]) for a, b in cuts[d][k:m]), d == first[k]))
                    k = m
            i = max(j, i + 1)
    return out


@pytest.mark.parametrize("passage", [0, 51])
def test_repeated_spans_by_definition(spark, passage):
    import random

    rng = random.Random(21)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    parts = [fresh(n) for n in (5, 12, 20, 35, 45, 52, 60, 90)]
    texts = {i: (fresh(rng.randrange(0, 40)) + "\n" + " ".join(rng.sample(parts, rng.randrange(0, 4))) + " " + fresh(rng.randrange(0, 30))).encode() for i in range(70)}
    texts |= {70: b"", 71: texts[3], 72: "漢字 é".encode() * 30}
    frame = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()] + [(None, "x y"), (73, None)], "doc_id long, text string")
    got = {tuple(r) for r in chunk_dedup.repeated_spans(frame, 11, passage).collect()}
    assert got == repeats_by_definition(texts, 11, passage) and got


def test_long_passages_are_found_and_short_ones_left(spark, texts):
    """Every document with 51 words that another has too, byte by byte, is in op3; what it reports may be such a passage."""
    raw = {d: t.encode() for d, t in texts.items()}
    starts = {d: [m.start() for m in re.finditer(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", t)] + [len(t)] for d, t in raw.items()}
    owners = defaultdict(set)
    for d, t in raw.items():
        for i in range(len(starts[d]) - 51):
            owners[t[starts[d][i] : starts[d][i + 51]].rstrip()].add(d)
    long = {d for who in owners.values() if len(who) > 1 for d in who}
    rows = QUERIES["op3_substring_dedup"](spark, SF).collect()
    found = {r.doc_id for r in rows}
    assert len(long & found) >= 0.97 * len(long)
    least = min(sum(r.n_words for r in rows if r.doc_id == d) for d in found)
    assert least >= 51 - 2 * chunk_dedup.MOST // 2


def rank_auc(rows, truth):
    rows = sorted((r for r in rows if r.held_out and r.doc_id in truth), key=lambda r: r.score)
    ones = [i for i, r in enumerate(rows) if truth[r.doc_id]]
    return (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(rows) - len(ones)))


@pytest.mark.parametrize(("name", "label", "mod", "held", "cut", "least"), [("op2_toxicity", "toxic", 5, 0, 0.5, 0.85), ("op10_quality_qda", "quality", 4, 2, 0.7, 0.98)])
def test_classifiers(spark, name, label, mod, held, cut, least):
    sf = SF.replace("0.001", "0.1")
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    assert rank_auc(rows, truth) > least


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, None), (None, 1)], "doc_id long, y int")
    for learn in (labels, labels.limit(0)):
        model = toxicity.train(docs, learn, "y")
        assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(none, model).count() == 0
        assert set(toxicity.drop_toxic(docs, model).columns) == set(docs.columns)
        stats = quality.document_statistics(docs)
        fitted = quality.train(stats, learn, "y")
        rows = quality.score(stats, fitted).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(quality.document_statistics(none), fitted).count() == 0
    assert toxicity.train(none, labels, "y").scores(["x"]).shape == (1,)


def test_repeated_spans_hold_in_text(spark, texts):
    for r in QUERIES["op3_substring_dedup"](spark, SF).collect():
        raw = texts[r.doc_id].encode()[r.start : r.end]
        assert len(raw.split()) >= r.n_words - 1


def test_quality_query_by_definition(spark, texts):
    """Learned and scored document by document from whole texts."""
    y = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    x = {d: quality.statistics([t.encode()])[0] for d, t in texts.items()}
    sums = {}
    for c in (0, 1):
        own = np.array([x[d] for d in x if d in y and y[d] == c and zlib.crc32(str(d).encode()) % 4 != 2])
        sums[c] = (float(len(own)), own.sum(0), own.T @ own)
    model = quality.fit_discriminant(sums)
    got = {r.doc_id: r.score for r in QUERIES["op10_quality_qda"](spark, SF).collect()}
    assert set(got) == set(x) and all(abs(got[d] - model.scores(x[d][None])[0]) < 1e-6 for d in x)


def test_equal_texts_score_alike(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, y int"), "y")
    assert model.scores([""])[0] == model.scores([" \n"])[0]
    assert len({r.score for r in toxicity.score(docs, model).filter("doc_id in (4, 5)").collect()}) == 1


#: Names that operators use inside, as columns of the documents.
CLASHING = ("key", "n", "node", "rep", "size", "row", "row_id", "text_hash", "copies", "component", "d1", "words", "chunk", "start", "pivot", "slot", "shard", "rank", "x", "y", "held_out", "score", "place", "taken", "fill", "members", "piece", "digest", "h", "src")


def test_results_do_not_depend_on_other_columns(spark, tmp_path, docs):
    """Every query over whole and over widened tables: the same rows."""
    bare, wide = f"file://{tmp_path}/bare", f"file://{tmp_path}/wide"
    plain = docs.drop("key", "n")
    widened = plain.select("*", *(F.lit(i if i % 2 else f"v{i}").alias(c) for i, c in enumerate(CLASHING)))
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0 / (i + 1), float(i)]) for i in range(250)], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for path, d, v in ((bare, plain, vectors), (wide, widened, vectors.select("*", F.lit("q").alias("v"), F.lit(1).alias("row"), F.lit(2).alias("block"), F.lit(3).alias("floor")))):
        d.write.parquet(f"{path}/documents.parquet")
        v.write.parquet(f"{path}/embeddings.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
    for name, query in QUERIES.items():
        one, two = (Counter(tuple(sorted((k, str(c)) for k, c in r.asDict().items() if k != "sequence_id" and k != "offset")) for r in query(spark, path).collect()) for path in (bare, wide))
        assert one == two, name


def test_very_long_texts(spark):
    """One text above the slices' bound and over 8 MiB among short ones, in every operator."""
    long = " ".join(f"w{i % 9973} v{i}" for i in range(700_000))
    assert len(long) > 8 << 20
    frame = spark.createDataFrame([(1, long + " token = abcdef123", "en", "a"), (2, "short text", "en", "a"), (3, long[: 1 << 20], "en", "b")], "doc_id long, text string, lang string, source string")
    digest = {r.doc_id: r for r in media.media_digest(frame).collect()}
    assert digest[1].n_bytes == len(long) + 18 and digest[1].payload_sha256 == hashlib.sha256(media.padded((long + " token = abcdef123").encode())).hexdigest()
    spans = {r.doc_id: r.spans for r in secrets.secret_spans(frame).collect()}
    assert spans[1] == f"assign:{len(long) + 1}:{len(long) + 18}" and spans[2] == ""
    sizes = {r.doc_id: (r.size, r.taken) for r in mixing.taken_words(frame).collect()}
    assert sizes[1][0] == 1_400_003 and all(t <= 2 * n for n, t in sizes.values())
    sets = {r.doc_id: r.n_shingles for r in jaccard_join.linked_components(frame).collect()}
    assert sets[1] == 1_400_001 and sets[2] == 1
    pieces = packing.pack_documents(frame).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("piece").alias("c")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3} and all(r.c == -(-r.n // 2048) for r in pieces)
    repeated = {r.doc_id for r in chunk_dedup.repeated_spans(frame).collect()}
    assert repeated == {1, 3}
    assert {r.doc_id: r.size for r in hilbert.shard_by_curve(frame).collect()}[1] == len(long) + 19
    stats = quality.document_statistics(frame)
    assert quality.score(stats, quality.train(stats, frame.select("doc_id", F.lit(1).alias("quality")))).count() == 3


def test_queries_take_extra_columns(spark, tmp_path, docs):
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for name in ("op1_media_flac", "op2_toxicity", "op4_ngram_jaccard_join", "op5_sharding_hilbert", "op7_secret_scans", "op9_mixing_sources", "op10_quality_qda"):
        assert QUERIES[name](spark, path).count() == len(ROWS), name
    assert QUERIES["op8_best_fit_packing"](spark, path).agg(F.count_distinct("doc_id")).first()[0] == len(ROWS) - 2
