"""The whole pipeline against its stages computed by brute force one after another."""

from __future__ import annotations

import base64
import os
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from compare import SMALL
from test_contracts import components_of, cut_repeats
from test_edges import common

from tilequarry.llm import linecrf

WHERE = os.environ.get("TEST_SF_DIR", SMALL)


def leaking(texts: dict, items: list[str], share: float = 0.6, answers: float = 0.5) -> set:
    """Documents with a window that an item aligns with, its rare terms included."""
    words = lambda t: re.findall(r"\w+", t.lower())
    bench = [w for w in map(words, items) if w]
    longest = max(map(len, bench))
    stride = max(32, longest // 2)
    size = longest + stride
    windows = {k: [d[s : s + size] for s in range(0, max(1, len(d) - size + stride), stride)] if d else [] for k, d in ((k, words(t)) for k, t in texts.items())}
    df = Counter(w for parts in windows.values() for part in parts for w in set(part))
    total = sum(map(len, windows.values()))
    idf = {w: np.log1p(total) - np.log1p(df[w]) + 1e-3 for item in bench for w in item}
    out = set()
    for item in bench:
        distinct = sorted(set(item), key=lambda w: (-idf[w], w))
        rare = set(distinct[: max(2, -(-len(distinct) // 4))])
        bag = Counter(item)
        for k, parts in windows.items():
            for part in parts:
                if k in out or (bag & Counter(part)).total() < share * len(item):
                    continue
                n, stop = common(item, part)
                if n >= share * len(item):
                    back = common(item[::-1], part[:stop][::-1])[1]
                    if len(rare.intersection(part[stop - back : stop])) >= max(1, int(np.ceil(answers * len(rare)))):
                        out.add(k)
    return out


def test_pipeline_as_its_stages_by_brute_force(spark):
    import tiktoken

    table = spark.read.parquet(f"{WHERE}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{WHERE}/documents.parquet").to_pylist()}
    field = linecrf.train(table, spark.read.parquet(f"{WHERE}/labels.parquet"))
    verdict = {r.doc_id: r.score for r in linecrf.score(table, field).collect()}
    texts = {k: t for k, t in texts.items() if verdict[k] >= 0.3}
    assert 0 < len(texts) < len(verdict)
    sets = {}
    for k, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = components_of(sets, 80)
    texts = {k: t for k, t in texts.items() if top[k] == k}
    assert len(texts) < len(sets)
    texts = {k: kept.decode("utf-8", "ignore") for k, (kept, _) in cut_repeats({k: t.encode() for k, t in texts.items()}).items()}
    gone = leaking(texts, [r["text"] or "" for r in pq.read_table(f"{WHERE}/benchmark.parquet").to_pylist()])
    assert gone
    with open(corpus_pipeline.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {k: plain.encode_ordinary(t) for k, t in texts.items() if k not in gone}
    rows = corpus_pipeline.run(spark, WHERE).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == want and len(rows) == len(want)
    assert all(r.n_tokens == len(want[r.doc_id]) for r in rows)
