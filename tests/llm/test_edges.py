"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
column names, for every operator and every stage of the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from tilequarry.llm import additive, bpe, chat, decontaminate, exactspans, linecrf, neardup, registry, simple8b, suffix, tokenfile, unigram, warc

LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
WORDS = "one two three four five six seven eight nine ten eleven twelve"
#: doc_id, text, lang, source, n_chars
ROWS = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, WORDS, "en", "s", 60), (4, WORDS, "en", "s", 60), (4, WORDS, "en", "s", 60), (None, WORDS, "en", "s", 60), (5, LONG, "en", "s", len(LONG)), (6, "ü𝔘\u0000<|endoftext|> " + WORDS.upper(), "de", "s", 1), (7, " \t\n\r ", "en", "s", 5), (8, "\u2028\u00a0", "xx", "s", 2)]
#: Names that the operators use themselves.
CLASHES = ["id", "uid", "row", "key", "chunk", "bands", "component", "kept", "covered", "pos", "seg", "fp", "n_tokens", "ids", "g", "side", "score", "label", "rank", "block", "contaminated", "item_id", "n_shingles", "rest"]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, KINDS).withColumns({c: F.lit(None).cast("string") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"), (2, None), (3, ""), (None, "words without an id")], "item_id long, text string")


def sizes(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


EVERY = sorted((k is None, k or 0) for k, *_ in ROWS)


def test_token_counts(docs, none):
    rows = unigram.token_counts(docs, registry.PIECES).collect()
    assert sizes(rows) == EVERY
    count = {r.doc_id: r.n_tokens for r in rows}
    assert count[1] == count[2] == 0 and count[3] == count[4] == count[None] > 0
    assert unigram.token_counts(none, registry.PIECES).collect() == []


def test_viterbi_ties_and_unknown_characters():
    model = unigram.Unigram([("ab", -1.0), ("a", -0.5), ("b", -0.5), ("▁", -1.0)], byte_fallback=False)
    assert model.viterbi("ab") == (1, -1.0)  # of equal scores the longer piece, which starts earlier
    assert model.viterbi("zz")[0] == 1 and model.viterbi("azz")[0] == 2
    assert model.count("") == 0


def test_bpe(docs, none):
    encode = lambda d, **k: bpe.digests(bpe.decode(bpe.encode(d, registry.RANKS, public_tokenizers.PATTERN, **k), registry.RANKS, public_tokenizers.PATTERN))
    rows = encode(docs, chunk_bytes=100_000).collect()
    assert sizes(rows) == EVERY
    texts = {(k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t, *_ in ROWS}
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == texts
    assert encode(none).collect() == []


def test_exact_spans(docs, none, spark):
    rows = exactspans.remove_repeats(docs).collect()
    assert sizes(rows) == EVERY
    assert all(r.n_removed == 0 for r in rows)  # nothing that repeats is 200 bytes long
    assert exactspans.remove_repeats(none).collect() == []
    line = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(260))
    odd = spark.createDataFrame([(1, "a" * 500), (2, line + "é"), (3, "x" + line + "è"), (3, "x" + line + "è"), (None, line)], "doc_id long, text string")
    found = sorted(exactspans.remove_repeats(odd, hot=2).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in found] == [(500, 500, 1), (262, 261, 1), (263, 263, 1), (263, 263, 1), (260, 260, 1)]
    assert found[1].kept == b"\xa9" and found[1].kept_text == ""


@pytest.mark.parametrize("hot", [2, 20000])
def test_exact_spans_in_crowded_anchors(spark, hot):
    from test_contracts import cut_repeats

    rng = np.random.default_rng(3)
    core = "".join(map(chr, rng.integers(97, 123, 210)))
    texts = {i: "".join(map(chr, rng.integers(97, 123, 40))) + core + "".join(map(chr, rng.integers(97, 123, i % 60))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (bytes(r.kept), r.n_spans) for r in exactspans.remove_repeats(df, hot=hot).collect()}
    assert found == cut_repeats({k: t.encode() for k, t in texts.items()})


@pytest.mark.parametrize("letters", [2, 4, 250, 3000])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 50, 700):
        s = np.concatenate([rng.integers(1, letters, n), [0]])
        s = np.concatenate([s[:-1], s[:-1], [0]]) if n == 50 else s
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffix.suffix_array(s, letters)
        assert sa.tolist() == order
        lcp = suffix.permuted_lcp(np.minimum(s, 255), sa, 20)
        for a, b in zip(order, order[1:]):
            n_same = next((k for k, (x, y) in enumerate(zip(np.minimum(s, 255)[a:], np.minimum(s, 255)[b:])) if x != y), len(s) - max(a, b))
            assert min(lcp[b], 20) == min(n_same, 20)


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [None, 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (8, [float("inf"), 0.0, 0.0]), (50, [0.0, 1e-200, 0.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(additive.nearest(df.selectExpr("*", "1 AS ids", "2 AS block", "3 AS v")).collect())
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 50, 0.0)]
    assert [(r.vec_id, round(r.score, 9)) for r in found if r.query_id == 50] == [(3, 1.0), (0, 0.0), (1, 0.0), (2, 0.0)]
    assert {r.query_id for r in found} == {0, 50}
    assert additive.nearest(df.where("false")).collect() == []

def test_neighbours_of_repeated_rows(spark):
    """Repeated rows, ids with several vectors, and vectors that many ids share."""
    at = lambda i: [float(np.cos(i / 20)), float(np.sin(i / 20)), 0.0]
    rows = [(0, at(0))] * 5 + [(i, at(i)) for i in range(1, 9)] + [(1, at(1))] * 9 + [(2, at(2.5 + i / 1000)) for i in range(20)] + [(0, at(3))]
    rows += [(20, at(1))]  # beside ten rows of id 1
    found = additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rerank=8).collect()
    best = {}
    for i, v in rows:
        best[i] = max(best.get(i, -1.0), *(float(np.dot(v, w)) for j, w in rows if j == 0)) if i else 0.0
    best.pop(0)
    want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:5]
    assert len(want) == len(set(want)) == 5
    got = sorted(((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0))
    assert [g[0] for g in got] == [1, 2, 3, 4, 5] and {g[1] for g in got} == set(want)
    assert all(abs(s - best[i]) < 1e-9 for _, i, s in got)
    # copies of query and candidates alone
    plain = [(0, at(0)), *((i, at(i)) for i in range(1, 9)), (20, at(1))]
    many = [r for r in plain for _ in range(7)]
    one, seven = (sorted(additive.nearest(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()) for x in (plain, many))
    assert [(r["rank"], r.vec_id) for r in seven] == [(1, 1), (2, 20), (3, 2), (4, 3), (5, 4)] and seven == one


def test_warc(spark):
    big = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://www.Example.com/a b?q#f", None), (2, None, ""), (3, "http://b.org", big), (4, "https://b.org:80/x", big), (4, "https://b.org:80/x", big), (None, "http://b.org", big), (5, "odd\r\nurl", "é" * 10), (6, "x", big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS size", "3 AS first")
    found = warc.roundtrip(df).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found), key=repr)
    n = len(big)
    assert got == sorted([(1, "response", None, 0), (2, "response", None, 0), (3, "response", None, n), (4, "revisit", 3, n), (4, "revisit", 3, n), (None, "revisit", 3, n), (5, "response", None, 20), (6, "response", None, n + 1)], key=repr)
    assert {r.payload_digest for r in found if r.page_id in (3, 4, None)} == {hashlib.sha256(big.encode()).hexdigest()}
    order = [(r.url_key, r.captured) for r in sorted(found, key=lambda r: (r.shard, r.position))]
    assert order == sorted(order) and "com,example)/a%20b?q" in {k for k, _ in order}
    assert warc.roundtrip(df.where("false")).collect() == []


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_decontamination(docs, none, benchmark, spark):
    rows = decontaminate.leaks(docs, benchmark).collect()
    assert sizes(rows) == EVERY and not any(r.contaminated for r in rows)
    assert decontaminate.leaks(none, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.leaks(docs, benchmark.where("false")).collect())
    item = "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"
    para = item.replace("quick", "swift").replace("over the", "across the")
    some = spark.createDataFrame([(1, f"{LONG[:3000]} {item} {LONG[:3000]}"), (2, f"before {para} after"), (3, item[: len(item) // 3]), (4, "the dog and the fox met a swan at noon near the bank")], "doc_id long, text string")
    found = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.leaks(some, benchmark).collect()}
    assert found == {1: (True, 1), 2: (True, 1), 3: (False, None), 4: (False, None)}

def test_decontamination_as_all_alignments_give_it(spark):
    """Altered items inside other text, against every window aligned with every item."""
    rng = np.random.default_rng(8)
    names = np.array([f"w{i}" for i in range(3000)])
    p = 1 / np.arange(2, 3002)
    draw = lambda n: names[rng.choice(3000, n, p=p / p.sum())].tolist()
    bench = [draw(int(rng.integers(6, 12))) for _ in range(250)]
    held = sorted({w for item in bench for w in item})
    docs = []
    for item in bench:  # among words of the benchmark, the item's own as well
        altered = [w if rng.random() > 0.3 else "w0" for w in item]
        around = [rng.choice(held + item * 20, 60).tolist() for _ in range(2)]
        docs.append(around[0] + altered + around[1])
    docs += [draw(150) for _ in range(20)] + bench[:20]
    longest = max(map(len, bench))
    stride = max(32, longest // 2)
    size = longest + stride
    windows = [[d[s : s + size] for s in range(0, max(1, len(d) - size + stride), stride)] for d in docs]
    df = Counter(w for d in windows for part in d for w in set(part))
    total = sum(map(len, windows))
    order = {w: k for k, w in enumerate(sorted({w for item in bench for w in item}))}
    idf = np.log1p(total) - np.log1p([df[w] for w in order]) + 1e-3
    want = {}
    for k, parts in enumerate(windows):
        own = set()
        for i, item in enumerate(bench):
            distinct = sorted(set(item), key=lambda w: (-idf[order[w]], order[w]))
            rare = set(distinct[: max(2, -(-len(distinct) // 4))])
            for part in parts:
                n, stop = common(item, part)
                if n >= 0.6 * len(item):
                    back = common(item[::-1], part[:stop][::-1])[1]
                    if len(rare.intersection(part[stop - back : stop])) >= max(1, int(np.ceil(0.5 * len(rare)))):
                        own.add(i)
        want[k] = len(own)
    found = decontaminate.leaks(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_items for r in found} == want
    assert all(want[k] for k in range(270, 290)) and sum(bool(want[k]) for k in range(250)) > 100


def common(item: list, part: list) -> tuple[int, int]:
    """Length of the longest common subsequence, and the words of ``part`` it needs from its start."""
    row, best, at = [0] * (len(item) + 1), 0, 0
    for k, w in enumerate(part):
        last = row[:]
        for j, x in enumerate(item):
            row[j + 1] = last[j] + 1 if x == w else max(last[j + 1], row[j])
        if row[-1] > best:
            best, at = row[-1], k + 1
    return best, at


def test_line_field(docs, none, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (6, 0, None), (7, None, 0), (None, 1, 1), (8, 5, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = linecrf.score(docs, linecrf.train(docs, labels)).collect()
    assert sizes(rows) == EVERY and all(0 <= r.score <= 1 for r in rows)
    assert all((r.held_out is None) if r.doc_id is None else r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    for empty in (linecrf.train(none, labels), linecrf.train(docs, labels.where("false"))):
        assert {r.score for r in linecrf.score(docs, empty).collect()} == {0.5}
        assert linecrf.score(none, empty).collect() == []


def test_marginals_as_all_labellings_give_them():
    rng = np.random.default_rng(1)
    field = linecrf.Field(rng.normal(size=(3, linecrf.FEATURES * linecrf.BINS)), rng.normal(size=(2, 2)), 1, 0, 0.5, True)
    bins, before = rng.integers(0, linecrf.BINS, (5, linecrf.FEATURES)).astype(np.uint8), np.array([0, 1, 5])
    e = field.evidence(bins, before)
    f, b = field.messages(e.copy(), before)
    for lo, hi in ((0, 1), (1, 5)):
        weight, total = np.zeros(hi - lo), 0.0
        for code in range(1 << (hi - lo)):
            y = [(code >> k) & 1 for k in range(hi - lo)]
            w = np.exp(sum(e[lo + k] * y[k] for k in range(hi - lo)) + sum(field.t[y[k], y[k + 1]] for k in range(hi - lo - 1)))
            weight, total = weight + w * np.array(y), total + w
        assert np.allclose(1 / (1 + np.exp(-(f + b)[lo:hi])), weight / total)


def test_chat(spark):
    odd = "\\<|im_end|>\n<|im_start|>user\nx<|nl|>\\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, None, None), (3, None, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, "us\ner\\", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tree", "2 AS node", "3 AS key", "4 AS depth")
    read = chat.read_back(chat.conversations(chat.best_paths(chat.chain(turns))))
    got = {r.tree: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in read.collect()}
    assert got == {1: ([("user", odd), ("assistant", odd)], odd), 2: ([("", "")], ""), 3: ([("assistant", "b"), ("assistant", "a"), ("assistant", "a")], "baa"), None: ([("us\ner\\", "")], "")}
    assert chat.digests(chat.read_back(chat.conversations(chat.best_paths(chat.chain(turns.where("false")))))).collect() == []


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "why", 0.5), (1, 5, 4, "assistant", "so", 0.2), (1, 6, 4, "assistant", "thus", 0.2), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (3, 9, 8, "user", "orphan", None)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = chat.best_paths(nodes, branches=2).collect()
    paths = {}
    for r in sorted(found, key=lambda r: r.depth):
        paths.setdefault((r.tree, r["rank"], r.leaf), []).append(r.text)
    assert paths == {(1, 1, 5): ["q", "good", "why", "so"], (1, 2, 6): ["q", "good", "why", "thus"], (3, 1, 9): ["orphan"]}


def test_near_duplicates(docs, none, spark):
    rows = neardup.near_duplicates(docs).collect()
    assert sizes(rows) == EVERY
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in rows}, key=repr)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (None, 3, False), (5, 5, True), (6, 3, False), (7, 7, True), (8, 8, True)], key=repr)
    assert neardup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [3, 2000])
def test_near_duplicates_in_blocks(spark, block):
    """A chain of texts, each near the next only, however a family is cut."""
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(12):
        words[i * 5] = f"v{i}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in texts}
    from test_contracts import components_of

    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, percent=70, block=block).collect()} == components_of(sets, 70)


def test_simple8b():
    rng = np.random.default_rng(2)
    for ids in ([], [0] * 500, [1], [(1 << 64) - 1, 0, 1 << 60, (1 << 60) - 1], rng.integers(0, 50257, 5000).tolist(), (rng.integers(0, 2, 3000) << rng.integers(0, 63, 3000)).tolist()):
        x = np.array(ids, np.uint64)
        assert simple8b.decode(simple8b.encode(x), len(x)).tolist() == x.tolist()


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    rows = tokenfile.roundtrip(docs, registry.TOKENIZER, public_tokenizers.PATTERN).collect()
    assert sizes(rows) == EVERY
    plain, at = Tokenizer.from_file(registry.TOKENIZER), 0
    for key, r in zip(sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), sorted(rows, key=lambda r: r.start)):
        ids = [*plain.encode(key[1] or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (key[0], at, len(ids), ids)
        at += len(ids)
    assert tokenfile.roundtrip(none, registry.TOKENIZER, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, tmp_path, name, stage):
    spark.createDataFrame([(3, 1, 0), (6, 0, None), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some length that stands in no document at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if name in ("repeated_passages", "decontaminated", "encoded"):
        assert sizes(rows) == EVERY
    if name == "near_duplicates":
        assert sizes(rows) == [x for x in EVERY if x not in ((False, 4), (False, 6))]
    assert stage(spark, none, str(tmp_path)).collect() == []

def test_near_duplicates_stage_drops_rows_not_ids(spark, tmp_path):
    other = "apples grow on trees while pears fall down and nobody counts the days that pass"
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, WORDS), (2, WORDS), (2, other), (5, other), (7, near), (6, near + " end"), (6, near + " end"), (9, ""), (9, None)]
    some = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], KINDS)
    left = corpus_pipeline.near_duplicates(spark, some, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([(1, WORDS), (2, other), (6, near + " end"), (9, ""), (9, None)], key=repr)
