"""The registered queries over whole tables against plain Python and DuckDB."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from compare import SMALL, differences, oracle

from tilequarry.llm import registry, unigram

WHERE = os.environ.get("TEST_SF_DIR", SMALL)


def table(name):
    return pq.read_table(f"{WHERE}/{name}.parquet").to_pylist()


def run(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, WHERE).collect()]


def by(rows, key="doc_id"):
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_sql(spark, name):
    assert not differences(registry.QUERIES[name](spark, WHERE).toArrow(), oracle(registry.ORACLES[name], WHERE))


def test_op1_counts_as_the_library(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = unigram.pieces(open(registry.PIECES, "rb").read())
    plain = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    found = by(run(spark, "op1_token_counts"))
    assert found.keys() == docs.keys()
    for k, text in docs.items():
        assert found[k]["n_tokens"] == len(plain.encode(text, add_special_tokens=False).ids), k


def test_op2_ids_as_the_library(spark, docs):
    import tiktoken

    with open(registry.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = by(run(spark, "op2_bpe_roundtrip"))
    assert found.keys() == docs.keys()
    for k, text in docs.items():
        ids = plain.encode_ordinary(text)
        assert found[k] == {"doc_id": k, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}


def cut_repeats(texts: dict, length: int = 200) -> dict:
    """id: (kept bytes, spans) by a count of all strings."""
    seen = Counter()
    for t in texts.values():
        seen.update(hash(t[i : i + length]) for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out[k] = (np.frombuffer(t, np.uint8)[~gone].tobytes(), spans)
    return out


def test_op3_removes_what_a_count_of_all_strings_finds(spark, docs):
    raw = {k: t.encode() for k, t in docs.items()}
    found = by(run(spark, "op3_suffix_dedup"))
    for k, (kept, spans) in cut_repeats(raw).items():
        assert found[k] == {"doc_id": k, "n_bytes": len(raw[k]), "n_removed": len(raw[k]) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}, k


def test_op4_scores_are_cosines_and_recall_is_high(spark):
    rows = [r for r in table("embeddings") if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in run(spark, "op4_additive_neighbours"):
        found[r["query_id"]].append(r)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        got = sorted(found.pop(int(ids[q])), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        score = unit @ unit[q]
        score[ids == ids[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hits, total = hits + len(best & {r["vec_id"] for r in got}), total + 5
        at = {int(i): s for i, s in zip(ids, score)}
        assert all(abs(at[r["vec_id"]] - r["score"]) < 1e-9 for r in got)
        assert got == sorted(got, key=lambda r: (-r["score"], r["vec_id"]))
    assert not found and hits >= 0.9 * total


def test_op7_held_out_accuracy(spark, docs):
    from measures import auc

    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    found = by(run(spark, "op7_line_crf"))
    assert found.keys() == docs.keys()
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(found[k]["score"], v) for k, v in labels.items() if k in found and found[k]["held_out"]]
    assert auc(held) > 0.85
    assert np.mean([(s >= 0.3) == v for s, v in held]) > 0.8


def test_op9_links_as_all_pairs_do(spark, docs):
    import re

    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in docs.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(lower))
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    top = components_of(sets, 85)
    found = by(run(spark, "op9_near_duplicates"))
    assert found == {k: {"doc_id": k, "n_shingles": len(sets[k]), "component_id": top[k], "kept": top[k] == k} for k in docs}


def components_of(sets: dict, percent: int) -> dict:
    """id: the smallest id linked with it, by way of all pairs that share a shingle."""
    owners = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            owners[x].append(k)
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in sets.items():
        both = Counter(j for x in s for j in owners[x] if j < k)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(j), find(k)
                up[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def test_op10_files_hold_the_library_s_ids(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(registry.TOKENIZER)
    found, start = by(run(spark, "op10_token_files")), 0
    assert found.keys() == docs.keys()
    for k in sorted(docs):
        ids = [*plain.encode(docs[k], add_special_tokens=False).ids, 0]
        assert found[k] == {"doc_id": k, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
