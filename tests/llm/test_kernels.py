"""Kernels without Spark: codec, decoding worklist, curve, packing, permutation, trees, sketches."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
from collections import Counter
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.llm import chunk_dedup, cover_tree, flac, hilbert, jaccard_join, mixing, packing, quality, secrets, toxicity
from citeweave.llm.media import padded
from citeweave.llm.textops import shingles, words_of


def back(streams):
    return [(x + 128).astype(np.uint8).tobytes() for x in flac.decode_streams(streams)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5))
def test_flac_round_trip(raw):
    payloads = [padded(r) for r in raw]
    assert back(flac.encode_streams(payloads)) == payloads


def test_flac_shapes_and_damage():
    rng = random.Random(1)
    payloads = [bytes(64), b"a" * 640, bytes(range(256)) * 8, bytes(rng.randrange(256) for _ in range(6400)), bytes([0] * 500 + [255] + [0] * 523), ("the nation of " * 5000).encode()[: 64 * 1000]]
    streams = flac.encode_streams(payloads)
    assert back(streams) == payloads
    s = streams[3]
    at = s.index(b"\x83")
    table = int.from_bytes(s[at + 1 : at + 4], "big")
    bare = s[:4] + b"\x80" + s[5:at] + s[at + 4 + table :]
    assert back([bare]) == [payloads[3]]  # frames are found without a seek table
    assert (flac.decode_from(s, 700, 900) + 128).astype(np.uint8).tobytes() == payloads[3][700:1600]
    for place in (-1, -40, at + 4 + table + 2, at + 4 + table + 30):
        broken = bytearray(s)
        broken[place] ^= 16
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([b"RIFF"])
    longest = max(flac.read_info(x).starts for x in streams)
    assert len(longest) == 125 and {i * flac.BLOCK for i in range(125)} == set(flac.read_info(streams[5]).first_sample)


def test_flac_reads_other_predictors():
    """A hand-built frame: fixed order 3, one escaped partition of 4-bit residuals."""
    n, pcm = 16, np.cumsum(np.cumsum(np.cumsum(np.ones(16, np.int64)))) % 50
    bits = f"{0:01b}{8 + 3:06b}{0:01b}"
    bits += "".join(f"{int(v) & 0xFF:08b}" for v in pcm[:3])
    r = pcm[3:] - (3 * pcm[2:-1] - 3 * pcm[1:-2] + pcm[:-3])
    wide = max(2, int(np.abs(r).max()).bit_length() + 1)
    bits += "00" + "0000" + "1111" + f"{wide:05b}" + "".join(f"{int(v) & ((1 << wide) - 1):0{wide}b}" for v in r)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0, n - 1])
    head += bytes([int(flac._crc8(np.frombuffer(head, np.uint8), np.zeros(1, np.int64), np.array([6]))[0])])
    frame = head + body
    frame += int(flac._crc16(np.frombuffer(frame, np.uint8), np.zeros(1, np.int64), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = bytes(10) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm.astype("<i1").tobytes()).digest()
    assert (flac.decode_streams([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame])[0] == pcm).all()


def naive_base(text):
    out = []
    for k, p in enumerate((secrets.ASSIGN.pattern, "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        import re

        for m in re.finditer(p, text, re.I | re.A if k == 0 else re.A):
            size = len(m[2]) if k == 0 else len(m[0])
            if size >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "SECRET", "token", "api_key", "apikey", "=", ": ", '"', "'", " ", "abcdef", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef0123", "é", "ſ", "\n", "x"])).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == naive_base(text)


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode().rstrip("="), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(bz2.compress(s.encode())).decode(), lambda s: base64.b64encode(lzma.compress(s.encode())).decode(), lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"\\u{ord(c):04x}" for c in base64.b64encode(s.encode()).decode()), lambda s: base64.b64encode(base64.b64encode(gzip.compress(s.encode()))).decode(),
])
def test_layers_are_unwrapped(wrap):
    inner = wrap("some words, then password = hunter2hunter2 and the rest of it")
    text = f"before {inner} after"
    base, spans, layers = secrets.scan_text(text)
    hits = [(a, b) for a, k, b in spans if k == 0 and (a, k, b) not in base]
    assert layers > 1 and hits and all(7 <= a < b <= 7 + len(inner) for a, b in hits)
    assert set(base) <= set(spans)
    assert "hunter2" not in secrets.redact_text(text) and secrets.redact_text(text).startswith("before ")


@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda b: base64.b64encode(b)])
def test_every_copy_of_a_blob_is_found(pack):
    blob = base64.b64encode(pack(b"some words, then password = hunter2hunter2 and the rest")).decode()
    text = f"one {blob} two {blob}\n%20 three {blob}"
    at = [i for i in range(len(text)) if text.startswith(blob, i)]
    _, spans, layers = secrets.scan_text(text)
    assert all(any(i <= a < b <= i + len(blob) for a, k, b in spans if k == 0) for i in at)
    clean = secrets.redact_text(text)
    assert clean.count("[secret]") == 3 and blob not in clean and layers < 8


def zstd(raw):
    import zstandard

    return zstandard.ZstdCompressor().compress(raw)


SECRET = b"some words, then password = hunter2hunter2 and the rest"


@pytest.mark.parametrize("payload", [
    gzip.compress(zlib.compress(SECRET)), gzip.compress(gzip.compress(bz2.compress(SECRET))), zstd(lzma.compress(SECRET)), zstd(SECRET), gzip.compress(b"first") + gzip.compress(SECRET), bz2.compress(b"first") + bz2.compress(SECRET),
    lzma.compress(b"first") + lzma.compress(SECRET), zlib.compress(b"first") + zlib.compress(SECRET), zstd(b"first") + zstd(SECRET), gzip.compress(SECRET[:25]) + gzip.compress(SECRET[25:]), gzip.compress(SECRET)[:-4] + b"oops",
    gzip.compress(bytes(9 << 20) + gzip.compress(SECRET)), gzip.compress(b"caf\xe9 " + SECRET), gzip.compress(base64.b64encode(zlib.compress(SECRET))),
], ids=range(14))
def test_payloads_are_unpacked_to_the_end(payload):
    text = f"before {base64.b64encode(payload).decode()} after"
    assert secrets.redact_text(text) == "before [secret] after"


def test_windows_may_cut_a_character(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 200)
    for shift in range(3):
        content = b"x" * shift + "漢".encode() * 900 + SECRET
        for inner in (content, gzip.compress(content + random.Random(1).randbytes(3000))):
            text = base64.b64encode(gzip.compress(inner)).decode()
            assert secrets.redact_text(text) == "[secret]"


def wrapped(raw, width=76, line="\n"):
    blob = base64.b64encode(raw).decode()
    return line.join(blob[i : i + width] for i in range(0, len(blob), width))


@pytest.mark.parametrize("raw", [SECRET, gzip.compress(SECRET), zlib.compress(SECRET)], ids=["plain", "gzip", "zlib"])
@pytest.mark.parametrize("glue", ["https://host/cb/", "Bearer-", "key_", "ab", "abc", "a-very-long-word-before-it-", ""])
def test_glued_blobs_are_found(glue, raw):
    text = f"see {glue}{base64.urlsafe_b64encode(raw).decode()} there"
    clean = secrets.redact_text(text)
    assert "[secret]" in clean and clean.startswith(f"see {glue[:-1]}") and "cGFzc3dvcmQg" not in clean and clean.endswith(" there")
    assert secrets.scan_text(text)[2] < 4


@pytest.mark.parametrize("odd", [b"\0", b"\x1b[0m", b"\xe9", b"\xff\xfe"], ids=range(4))
def test_odd_bytes_hide_nothing(odd):
    for raw in (odd + SECRET, SECRET + odd, odd + base64.b64encode(SECRET)):
        assert "[secret]" in secrets.redact_text(base64.b64encode(raw).decode())


@pytest.mark.parametrize("line", ["\n", "\r\n", "\n    "])
def test_wrapped_blobs_are_one(line):
    for lead in range(50, 62):
        text = "head: " + wrapped(b"w " * (lead // 2) + b"w" * (lead % 2) + b" token = abcdefghijklmnopqrstuvwxyz0123 and more" * 2, 76, line) + "\ntail"
        clean = secrets.redact_text(text)
        assert clean.count("[secret]") == 2 and clean.startswith("head: dyB3IHcg") and "abcdef" not in "".join(c.text for c in secrets._base64_children(secrets.Layer(clean, range(len(clean)), range(len(clean)))) if isinstance(c, secrets.Layer))
    packed = wrapped(lzma.compress(random.Random(1).randbytes(300) + SECRET), 64, line)
    assert secrets.redact_text(f"x {packed}") == "x [secret]"


#: Every layer by itself: text to text, or (packed) bytes to bytes.
WRITTEN = {
    "percent": lambda t: "".join(f"%{b:02x}" for b in t.encode()), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "hex": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(), "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), "wrapped": lambda t: wrapped(t.encode()),
}
PACKED = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": lambda raw: zstd(raw)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*WRITTEN, *PACKED]), min_size=1, max_size=4), st.integers(0, 30))
def test_any_nesting_is_unwrapped(layers, lead):
    content: str | bytes = "w " * lead + "password = hunter2hunter2 and more words"
    for name in layers:
        if name in PACKED:
            content = PACKED[name](content.encode() if isinstance(content, str) else content)
        elif isinstance(content, bytes):  # compressed bytes enter a text by base64 only
            content = wrapped(content) if name == "wrapped" else base64.b64encode(content).decode()
        else:
            content = WRITTEN[name](content)
    blob = base64.b64encode(content).decode() if isinstance(content, bytes) else content
    text = f"before: {blob} after"
    spans = secrets.scan_text(text)[1]
    assert any(k == 0 and 8 <= a < b <= 8 + len(blob) for a, k, b in spans)
    assert secrets.redact_text(text).startswith("before: ") and secrets.redact_text(text).endswith(" after")


@pytest.mark.parametrize("shift", range(4))
def test_texts_beyond_a_window_keep_their_secrets(shift):
    """More than 8 MiB of three-byte characters, cut anywhere within one, with secrets early, late and across the window's end."""
    body = "漢".encode() * 2_800_000
    for at in (0, secrets.WINDOW - 20 - shift, len(body)):
        at -= at % 3
        raw = b"x" * shift + body[:at] + b" " + SECRET + b" " + body[at:]
        text = f"see {base64.b64encode(gzip.compress(raw, 1)).decode()} there"
        assert secrets.redact_text(text) == "see [secret] there"


def test_cycles_and_plain_text():
    assert secrets.scan_text("%2525252525") [2] < 8
    assert secrets.scan_text("") == ([], [], 1)
    assert secrets.redact_text("token = abcdef, password: zzzzzz.") == "[secret], [secret]"


def test_hilbert_steps_are_short():
    g = np.array(np.meshgrid(range(8), range(8), range(8))).reshape(3, -1)
    h = hilbert.hilbert_index(g, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(g[:, np.argsort(h)], axis=1)).sum(0) == 1).all()


def test_best_fit_is_valid_and_near_the_bound():
    sizes = np.random.default_rng(0).integers(1, 2049, 5000)
    bins = packing.best_fit(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(5000)) and all(sizes[b].sum() <= 2048 for b in bins)
    assert len(bins) <= 1.03 * -(-sizes.sum() // 2048)


@pytest.mark.parametrize("total", [1, 2047, 2048, 2049, 4096, 5000])
def test_cut(total):
    parts = packing.cut(total)
    assert sum(n for _, n in parts) == total and all(n == 2048 for _, n in parts[1:]) and parts[0][0] == 0 and all(n <= 2048 for _, n in parts)


def test_encoder_agrees_with_the_tokenizers_file():
    from tokenizers import Tokenizer

    paths = packing.default_vocabulary()
    slow, fast = Tokenizer.from_file(paths[0]), packing.encoder(paths)
    for t in ["", " ", "The nation", "a  b\n\n c\t", "déjà vu 123 été", "<|endoftext|> x", "漢字かな", "​﻿", "x" * 3000, "it's we'll I'd"]:
        assert fast.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_encoders_agree_on_ten_thousand_texts():
    """Whole documents of the synthetic table and hostile strings: the faster encoder gives the tokenizers file's ids."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    paths = packing.default_vocabulary()
    slow, fast, rng = Tokenizer.from_file(paths[0]), packing.encoder(paths), random.Random(12)
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist() if t][::2]
    alphabet = " \t\n\r\x0b\x85\u2028\u3000'abZ09éß漢\U0001f600\u0301\u200d\ufeff\x00\x1f!?-_<|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)] + ["'s" * 50, "<|endoftext|>" * 3, " " * 999, "\n" * 333 + "x", "a" * 5000]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for t, e in zip(part, slow.encode_batch(part, add_special_tokens=False), strict=True):
            assert fast.ids(t).tolist() == e.ids, t[:80]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, 5)
    assert sorted(p) == list(range(n))
    assert n < 10 or (p != mixing.permuted(np.arange(n), n, 6)).any()
    assert mixing.permuted(p, n, 5, inverse=True).tolist() == list(range(n))


def test_targets_and_draws():
    t = mixing.targets([100, 1000, 10, 0], [5, 2, 1, 5])
    assert t[0] == 200 and t[2] == 20 and t[3] == 0 and abs(sum(t) - 1.5 * 1110) < 1e-6
    for words, want in ((1300, 1900.4), (513, 1026.0), (10, 15.0), (512, 300.0)):
        plan = mixing.plan_source(words, want, 3)
        sizes = [min(512, words - b * 512) for b in range(plan.blocks)]
        taken = sum(sizes[int(mixing.permuted(np.array([s % plan.blocks]), plan.blocks, 3 * mixing.PASSES + s // plan.blocks)[0])] for s in range(plan.draws - 1))
        assert taken + plan.last_words == round(want)
    counts = mixing.shard_counts([500, 30, 0, 1], 7)
    assert counts.sum(0).tolist() == [500, 30, 0, 1] and np.ptp(counts.sum(1)) <= 1


def test_plans_of_very_many_slots():
    """5 * 10^13 words are 10^11 blocks: planned without listing them, counted without the generator's limit."""
    words = 512 * 10**11 - 300
    plans = [mixing.plan_source(w, t, i) for i, (w, t) in enumerate([(words, 1.7 * words), (words // 3, 0.6 * words), (5000, 9000.0)])]
    for p in plans:
        assert 0 < p.last_words <= 512 and (p.draws - 1) * 512 - 2 * 511 + p.last_words <= p.goal <= p.draws * 512
    counts = mixing.shard_counts([p.draws for p in plans], 64)
    assert counts.sum(0).tolist() == [p.draws for p in plans] and np.ptp(counts.sum(1)) <= 1 and (counts >= 0).all()
    share = plans[0].draws / sum(p.draws for p in plans)
    assert (np.abs(counts[:, 0] / counts.sum(1) - share) < 1e-3).all() and len(set(counts[:, 0].tolist())) > 32


def test_large_hypergeometric_draws_have_the_right_spread():
    rng = np.random.default_rng(3)
    for good, bad, n in ((10**9, 3 * 10**9, 4000), (2 * 10**9, 40, 10**9), (5000, 2 * 10**9, 10**9), (10**12, 10**12, 10**12)):
        x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(300 if n < 10**10 else 60)], float)
        share = good / (good + bad)
        mean, var = n * share, n * share * (1 - share) * (good + bad - n) / (good + bad - 1)
        assert abs(x.mean() - mean) < 5 * np.sqrt(var / len(x)) + 1e-9 * mean and 0.5 * var < x.var() < 1.8 * var
    assert mixing.hypergeometric(rng, 0, 2 * 10**9, 5) == 0 and mixing.hypergeometric(rng, 2 * 10**9, 0, 5) == 5


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 40), st.integers(1, 20), st.integers(0, 3))
def test_dual_search_is_exact(n, q, spread, seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(-spread, spread + 1, (n, 4)) + 40 * rng.integers(0, 3, (n, 1))
    ids = rng.permutation(n * 2)[:n]
    pick = rng.integers(0, n, q)
    top = cover_tree.dual_search(data[pick], ids[pick], data, ids, np.full(q, cover_tree.NONE), 5)
    for row, p in enumerate(pick):
        want = sorted((-int(data[p] @ data[j]), int(ids[j])) for j in range(n) if ids[j] != ids[p])[:5]
        got = [(-int(s), int(i)) for s, i in zip(top.score[row], top.id[row], strict=True) if s != np.iinfo(np.int64).min]
        assert got == want


def best_by_definition(queries, data, k):
    scores = queries @ data.T
    place = np.lexsort((np.broadcast_to(np.arange(len(data)), scores.shape), ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, place, 1), place


def clustered(rng, n, clusters, width, spread):
    centre = rng.normal(size=(clusters, width))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    points = centre[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, width))
    return np.floor(1024 * points).astype(np.int64)


def depth(node):
    return 1 + max(map(depth, node.children), default=0)


@pytest.mark.parametrize(("clusters", "width", "spread"), [(400, 64, 0.01), (2000, 64, 0.01), (100, 64, 0.05), (400, 8, 0.02)])
def test_dual_search_prunes_clusters(clusters, width, spread):
    """At most half of all pairs are scored or bounded."""
    x = clustered(np.random.default_rng(1), 8400, clusters, width, spread)
    queries, data = x[:400], x[400:]
    top = cover_tree.dual_search(queries, np.arange(10**6, 10**6 + 400), data, np.arange(8000), np.full(400, cover_tree.NONE))
    score, place = best_by_definition(queries, data, 10)
    assert (top.score == score).all() and (top.id == place).all()
    assert (top.scored + top.bounded) / (400 * 8000) < 0.5
    assert depth(cover_tree.build_tree(data.astype(np.float64))) > 1


def test_query_tree_splits_clusters():
    x = clustered(np.random.default_rng(2), 400, 8, 64, 0.01)
    tree = cover_tree.build_tree(x.astype(np.float64), cover_tree.QUERY_LEAF)
    assert depth(tree) > 1 and sorted(np.concatenate([c.places for c in tree.children]).tolist()) == list(range(400))
    leaves = lambda node: [x for c in node.children for x in leaves(c)] or [node]
    assert len(leaves(tree)) >= 8 and max(leaf.radius for leaf in leaves(tree)) < tree.radius / 2


def test_scores_beyond_doubles_are_ordered():
    big = 1 << 29
    data = np.array([[big, 1], [big, 2], [big, 0]]) * np.array([4, 1])
    top = cover_tree.dual_search(np.array([[big * 4, 1]]), np.array([9]), data, np.arange(3), np.array([cover_tree.NONE]), 3)
    assert top.id.tolist() == [[1, 0, 2]] and top.score[0, 0] - top.score[0, 1] == 1


def test_trees_of_copies_and_lines():
    for x in (np.zeros((500, 3)), np.ones((500, 3)), np.vstack([np.zeros((400, 3)), np.ones((1, 3))]), np.arange(900.0)[:, None], 2.0 ** np.arange(200)[:, None]):
        work = [cover_tree.build_tree(x)]
        while work:
            node = work.pop()
            assert np.sqrt(((x[node.places] - node.centre) ** 2).sum(1)).max() <= node.radius
            assert not node.children or sorted(np.concatenate([c.places for c in node.children])) == sorted(node.places)
            work += node.children


def test_shingles_by_definition():
    texts = [b"A b c a b c", b"x", b"", b" \n", b"p q", "É é b".encode(), b"a b c"]
    hashes, offset = shingles(words_of(texts), len(texts), 3)
    assert np.diff(offset).tolist() == [3, 1, 0, 0, 1, 1, 1]
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offset, offset[1:], strict=False)]
    assert sets[6] < sets[0] and not sets[1] & sets[4]


def test_block_need_and_sketch_never_lose_a_link():
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    for percent in (80, 90):
        t = jaccard_join.Threshold(percent)
        for n in (9, 12, 19, 40, 150, 700):
            for _ in range(6):
                base = rng.choice(universe, n, replace=False)
                drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
                other = np.concatenate([base[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, drop) + 1))).astype(np.uint64)])
                a, b = np.unique(base), np.unique(other)
                shared = len(np.intersect1d(a, b))
                if (100 + percent) * shared < percent * (len(a) + len(b)):
                    continue
                flat, offset = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                keys, owner, need = jaccard_join.block_keys(flat, offset, percent)
                common = np.intersect1d(keys[owner == 0], keys[owner == 1])
                kinds = {int(k) & 63 for k in common.tolist()}
                assert any(sum(int(k) & 63 == c for k in common.tolist()) >= max(need[(keys & np.uint64(63)) == c].max(), 1) for c in kinds)
                x, y = jaccard_join.sketch_sets(flat, offset)
                assert jaccard_join.shared_bound(x, y) >= shared and shared >= t.overlap(len(a), len(b))


@pytest.mark.parametrize("percent", [80, 90])
def test_small_linked_pairs_have_their_needs(percent):
    """Each pair alone in a corpus: some class gives both documents as many common keys as they need."""
    rng, t, sets = np.random.default_rng(1), jaccard_join.Threshold(percent), []
    for n in [n for n in range(8, 31) for _ in range(2000)]:
        m = int(rng.integers(n, t.partners(n)[-1] + 1))
        shared = int(rng.integers(t.overlap(n, m), n + 1))
        drawn = rng.integers(0, 1 << 62, n + m - shared).astype(np.uint64)
        sets += [np.unique(drawn[:n]), np.unique(drawn[n - shared :])]
    keys, owner, need = jaccard_join.block_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), percent)
    order = np.lexsort((owner, keys, owner // 2))
    keys, owner, need = keys[order], owner[order], need[order]
    pair, kind = owner // 2, (keys & np.uint64(63)).astype(np.int64)
    group = pair * 64 + kind
    most, common = np.zeros(32 * len(sets), np.int64), np.zeros(32 * len(sets), np.int64)
    np.maximum.at(most, group, need)
    np.add.at(common, group[1:][(keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1])], 1)
    met = ((common >= most) & (common > 0)).reshape(-1, 64).any(1)
    assert met.all(), f"{(~met).sum()} of {len(met)} pairs"


def test_light_subsets_are_links():
    t = jaccard_join.Threshold(90)
    rng = random.Random(3)
    for n in range(9, 19):
        a = rng.sample(range(10**9), n)
        for b in (a[1:], a[:-1] + [10**9 + 1], [*a, 10**9 + 2], [*a[2:], 10**9 + 3]):
            inter = len(set(a) & set(b))
            link = inter >= t.overlap(len(a), len(b))
            keys = lambda s: {k for k, d in jaccard_join.subset_keys(s, 90, 40)}
            both = {k for k, d in jaccard_join.subset_keys(a, 90, 40) if not d or len(a) != len(b)} & keys(b)
            assert bool(both) == link or set(a) == set(b)


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)).encode()
    cuts = lambda t: {t[max([0, *(e for e in ends if e < x)]) : x] for ends in [chunk_dedup.chunk_ends([t])[2].tolist()] for x in ends}
    a, b = cuts(text), cuts(text[:700] + b"inserted words here " + text[700:])
    assert len(a & b) >= len(a) - 4
    raw, start, end, doc = chunk_dedup.chunk_ends([b"", b"Of " * 400, b"x", b""])
    assert np.diff(np.concatenate([[0], end[doc == 1]])).max() <= chunk_dedup.MOST and doc.tolist().count(2) == 1


def test_classifiers_learn_and_stay_defined():
    grams = [toxicity.packed(toxicity.grams_of(t)) for t in ["you idiot clown", "nice day here", "an idiot and a clown", "a nice calm day"] * 30]
    model = toxicity.fit_model(grams, np.array([1, 0, 1, 0] * 30), (60, 60))
    s = model.scores(["such an idiot clown", "what a nice day", ""])
    assert s[0] > 0.5 > s[1] and 0 <= s[2] <= 1
    flat = toxicity.fit_model([], np.zeros(0), (3, 0)).scores(["x", ""])
    assert (flat < 0.5).all() and len(set(flat)) == 1
    assert np.isfinite(quality.statistics([b"", b" ", b"a", "é é!! |\n|".encode()])).all()
    assert quality.fit_discriminant({}).scores(np.zeros((2, len(quality.STATISTICS)))).tolist() == [0.5, 0.5]


def test_toxicity_fit_solves_its_problem():
    """Counted and summed document by document: ratios by definition, and no slope left in the penalised loss."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = [" ".join(["vile"] * (i % 2 * rng.randrange(1, 4)) + [word() for _ in range(25)]) for i in range(80)]
    y = np.array([i % 2 for i in range(80)])
    sizes = (900, 100)
    model = toxicity.fit_model([toxicity.packed(toxicity.grams_of(t)) for t in texts], y, sizes)
    feature, total = [], [np.full(1 << toxicity.BITS, toxicity.SMOOTHING) for _ in (0, 1)]
    for t, label in zip(texts, y, strict=True):
        grams = toxicity.grams_of(t)
        own = {b: 10 * (c / (len(grams) + toxicity.OFFSET)) ** 0.5 for b, c in Counter(grams.tolist()).items()}
        feature.append(own)
        for b, v in own.items():
            total[label][b] += v
    ratio = np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())
    clear = np.abs(ratio) >= toxicity.SIGNIFICANCE * np.sqrt(1 / total[0] + 1 / total[1])
    assert (model.weights[~clear] == 0).all() and (model.weights != 0).any()
    scaled = [{b: v * ratio[b] for b, v in own.items() if clear[b]} for own in feature]
    scale = (len(texts) / sum(v * v for own in scaled for v in own.values())) ** 0.5
    prior = np.log((sizes[1] + 0.5) / (sizes[0] + 0.5))
    slope, slope_b, weight = Counter(), 0.0, {}
    for own, label in zip(scaled, y, strict=True):
        z = model.intercept - prior + np.log(y.sum() / (len(y) - y.sum()))
        for b, v in own.items():
            weight[b] = model.weights[b] / (ratio[b] * scale)
            z += weight[b] * v * scale
        r = 1 / (1 + np.exp(-z)) - label
        slope_b += r / len(texts)
        for b, v in own.items():
            slope[b] += r * v * scale / len(texts)
    assert abs(slope_b) < 1e-3 and max(abs(slope[b] + toxicity.PENALTY * weight[b]) for b in slope) < 1e-3


def test_discriminant_by_definition():
    rng = np.random.default_rng(8)
    size = 6
    x = np.concatenate([rng.normal(size=(60, size)) * [1, 2, 3, 1, 1, 9], rng.normal(size=(40, size)) @ rng.normal(size=(size, size)) + 1])
    y = np.repeat([0, 1], [60, 40])
    model = quality.fit_discriminant({c: (float((y == c).sum()), x[y == c].sum(0), x[y == c].T @ x[y == c]) for c in (0, 1)})
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (60 * cov[0] + 40 * cov[1]) / 100
    unit = np.diag(1 / np.sqrt(np.diag(pooled)))
    density = []
    for c in (0, 1):
        own = unit @ ((1 - quality.POOLED) * cov[c] + quality.POOLED * pooled) @ unit
        own = (1 - quality.SPHERICAL) * own + quality.SPHERICAL * np.trace(own) / size * np.eye(size)
        own = np.linalg.inv(unit) @ own @ np.linalg.inv(unit)
        away = x - x[y == c].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(own), away) - 0.5 * np.linalg.slogdet(own)[1])
    want = 1 / (1 + np.exp(-np.clip(np.log(40.5 / 60.5) + (density[1] - density[0]) / quality.TEMPERATURE, -40, 40)))
    assert np.allclose(model.scores(x), want, atol=1e-9)
