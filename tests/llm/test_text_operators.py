"""Quality rules, media, sharding, tokens and packing against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe, media, packing, planes, quality_rules, queries, sharding
from corvane.llm.tokens import library_encoder

from .conftest import prose

WORD, BYTE, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def key(row):
    return repr(tuple(row))


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, empty, texts):
    rows = quality_rules.rate(odd).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(d, *(c := counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t in texts]
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:7]) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows) and any(r.kept for r in rows)
    assert quality_rules.rate(empty).count() == 0
    assert quality_rules.rate(odd).select("row.*").columns == odd.columns


def test_quality_rejects_what_rules_agree_on(spark):
    good = [(i, prose(i, 60), 1) for i in range(40)]
    bad = [(100 + i, " | ".join(w + "&&&" for w in prose(100 + i, 40).split()), 0) for i in range(6)]
    rows = quality_rules.rate(spark.createDataFrame(good + bad, "doc_id long, text string, label int")).collect()
    assert all(r.kept == bool(r.row.label) for r in rows)


def test_media(odd, empty, texts):
    rows = media.media_features(odd).collect()
    want = []
    for d, t in texts:
        raw = t.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-576:])))
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:5]) for r in rows)
    assert media.media_features(empty).count() == 0


def test_media_query(spark, odd, texts, tmp_path):
    """The query's tail is the payload's last 32 bytes."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_media_columns(spark, str(tmp_path)).collect()
    want = []
    for d, t in texts:
        raw = t.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in rows)


def test_media_boxes():
    data = media.write_container(bytes(range(256)) * 9 * 9)
    kinds = [b"/".join(p) for p, _, _ in media.walk(data)]
    assert b"moov/trak/mdia/minf/stbl/stsz" in kinds and kinds[:2] == [b"ftyp", b"mdat"]
    (track,) = media.read_tracks(data)
    assert track["codec"] == "raw " and track["duration"] == 36 and track["sync"].tolist() == [0, 8, 16, 24, 32]
    assert b"".join(data[a : a + n] for a, n in zip(track["at"], track["sizes"])) == bytes(range(256)) * 81
    assert media.read_tracks(b"junk that is no container") == [] and list(media.walk(data[:20])) == []


def test_damaged_media(spark):
    import struct

    data = media.write_container(bytes(576 * 4))
    at = data.index(b"stsz") + 12
    broken = {
        "a table is longer than its box": data[: at - 4] + struct.pack(">II", 0, 10**6) + data[at + 4 :],
        "samples are larger than the data": data[:at] + struct.pack(">I", 10**9) + data[at + 4 :],
        "chunks and samples don't match": data[:at] + struct.pack(">I", 3) + data[at + 4 :],
        "fragmented": data + struct.pack(">I4s", 8, b"moof"),
        "samples lie outside the data": (lambda k: data[:k] + struct.pack(">I", 10**6) + data[k + 4 :])(data.index(b"stco") + 12 if b"stco" in data else data.index(b"co64") + 16),
    }
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", len(deep) + 8, b"moov") + deep
    rows = [(i, 1, x) for i, x in enumerate([*broken.values(), deep, b"", b"junk", None, data])]
    got = media.index_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).orderBy("doc_id").collect()
    assert [r.problem for r in got] == [*broken, None, None, None, None, None]
    assert all(r.codec is None for r in got[:-1]) and got[-1].n_samples == 4 and got[-1].payload_bytes == 576 * 4


def test_sharding(odd, empty, texts):
    rows = sharding.shard_documents(odd, shards=5).collect()
    assert sorted(map(key, [(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts])) == sorted(key(tuple(r)[:3]) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    where = collections.defaultdict(set)
    for r in rows:
        where[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("bits", [16, 3])
def test_shards_are_the_smallest(spark, monkeypatch, bits):
    import xxhash

    monkeypatch.setattr(sharding, "GROUP_BITS", bits)
    texts = [prose(i % 250, 5 + 37 * (i % 250) % 400) for i in range(300)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=7).collect()
    held = collections.Counter()
    for r in rows:
        held[r.shard] += r["size"]
    groups = collections.Counter()
    for t in texts:
        groups[xxhash.xxh64(t.encode(), seed=42).intdigest()] += len(t.encode()) + 16
    best = sharding.smallest_capacity(np.array([groups[k] for k in sorted(groups)]), 7)
    assert set(held) == set(range(7)) and sum(held.values()) == sum(groups.values())
    assert max(held.values()) == best if bits == 16 else best <= max(held.values()) <= 1.05 * best


def _minimax(sizes, shards):
    best = {(0, k): 0 for k in range(shards + 1)}
    for i in range(1, len(sizes) + 1):
        for k in range(shards + 1):
            best[i, k] = min((max(best[j, k - 1], sum(sizes[j:i])) for j in range(i)), default=10**9) if k else 10**9
    return min(best[len(sizes), k] for k in range(shards + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 5))
def test_minimax(sizes, shards):
    own = np.array(sizes)
    cuts = sharding.minimax_cuts(own, shards)
    assert cuts[0] == 0 and cuts[-1] == len(sizes) and (np.diff(cuts) >= 0).all()
    assert max(own[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:])) == _minimax(sizes, shards) == sharding.smallest_capacity(own, shards)


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {x: Tokenizer.from_file(x) for x in (WORD, BYTE)}


PARTS = st.lists(st.sampled_from(["word", "Wort", " ", "  ", "\n", "\t", "don't", "é", "日本", "!?", "12", " ", "　", "<|endoftext|>", "ab.", "\r\n", "\x1c", "ß", "İ"]), max_size=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS.map("".join), min_size=1, max_size=4))
def test_encoders_give_the_libraries_ids(libraries, texts):
    import base64

    import tiktoken

    for path, spaced in ((WORD, False), (BYTE, True)):
        ids, at = library_encoder(path, spaced)(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [x.ids for x in libraries[path].encode_batch(texts, add_special_tokens=False)]
    if not hasattr(test_encoders_give_the_libraries_ids, "own"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        test_encoders_give_the_libraries_ids.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, encoder = bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    ids, at = encoder(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [test_encoders_give_the_libraries_ids.own.encode_ordinary(x) for x in texts]
    assert own.decode(ids).tobytes() == "".join(texts).encode()


def test_byte_bpe_rows(spark, odd, empty, texts):
    import base64
    import random

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("rows", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdeghnorst") for _ in range(n)) for n in (300, 512, 513, 700, 4000)] + ["=" * 900, "é" * 400, "日本" * 300]
    more = list(enumerate(long, 1000))
    rows = bpe.encode_decode(odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for d, t in texts + more:
        ids = np.array(plain.encode_ordinary(t), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(key, want)) == sorted(map(key, rows))
    assert bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=300))
def test_planes_round_trip(ids):
    own = np.array(ids, np.uint32)
    assert (planes.unpack_planes(planes.pack_planes(own), len(own)) == own).all()
    image = planes.write_file(own, [7, None], np.array([len(own), 0]))
    got, docs, sizes = planes.read_file(image)
    assert (got == own).all() and docs == [7, None] and sizes.tolist() == [len(own), 0]


def test_token_files(odd, empty, texts, libraries):
    rows = planes.token_output(odd, BYTE).collect()
    known = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.start)
    want = {d: np.array([*libraries[BYTE].encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in texts if d is not None}
    assert len(rows) == len(texts) and [r.doc_id for r in known] == sorted(d for d, _ in texts if d is not None)
    assert all((r.n_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(want[r.doc_id])) for r in known)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert planes.token_output(empty, BYTE).count() == 0


def test_packing(odd, empty, texts, libraries):
    rows = packing.pack_documents(odd, WORD, capacity=512).collect()
    want = []
    for d, t in texts:
        ids = np.array([*libraries[WORD].encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512])) for k in range(0, len(ids), 512)]
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:5]) for r in rows)
    packed = collections.defaultdict(list)
    for r in rows:
        packed[r.sequence_id].append((r.offset, r.length))
    for own in packed.values():
        own.sort()
        assert [a for a, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist() and sum(n for _, n in own) <= 512
    assert packing.pack_documents(empty, WORD).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_plan(lengths):
    histogram = np.bincount(lengths, minlength=101) if lengths else np.zeros(101, np.int64)
    plan = packing.plan_packing(histogram, 100)
    table = plan.table()
    got = np.zeros(101, np.int64)
    np.add.at(got, table["length"], table["n"])
    assert (got == histogram).all()
    used = sum(n for slots, n, _ in plan.runs if slots)
    assert used <= max(1, 1.7 * -(-sum(lengths) // 100)) + 1 and all(sum(l * c for l, c in s) + room == 100 for s, n, room in plan.runs if n)


def test_packing_is_near_the_bound():
    lengths = np.clip(np.random.default_rng(3).lognormal(6.5, 0.8, 30_000).astype(int), 1, 4096)
    plan = packing.plan_packing(np.bincount(lengths, minlength=4097), 4096)
    assert sum(n for s, n, _ in plan.runs if s) <= 1.01 * -(-lengths.sum() // 4096)


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 8)), np.array([0, 1, 2, 0, 0, 3, 0, 4.0])
    assert np.allclose(packing.nnls(a, a @ x, 100), x, atol=1e-6)
