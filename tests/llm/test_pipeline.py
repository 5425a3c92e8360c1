"""The pipeline against the same stages by plain Python, each on the one before's result."""

from collections import Counter

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillspark.llm import bpe, mixing, neardup
from quillspark.llm import repeats as rp

from .test_neardup import brute as brute_classes
from .test_repeats import brute as brute_repeats

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        done = corpus_pipeline.common.written(stage(spark, docs, D), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
            docs = done
        out.append(done.collect())
    return out


def test_toxicity(results):
    toxic = {r["doc_id"] for r in pq.read_table(f"{D}/labels.parquet").to_pylist() if r["toxic"] == 1}
    gone = {r.doc_id for r in results[0]} - {r.doc_id for r in results[1]}
    assert len(gone & toxic) >= 0.4 * len(toxic) and len(gone) < 0.2 * len(results[0])  # 11 labelled texts teach little
    assert set(results[1]) <= set(results[0])


def test_near_duplicates(results):
    classes = brute_classes([(r.doc_id, r.text) for r in results[1]])
    assert {r.doc_id for r in results[2]} == {i for i, c in classes if i == c}
    assert set(results[2]) <= set(results[1])


def test_repeated_passages(results):
    after = {r.doc_id: r for r in results[3]}
    words = [(r.text or "").encode().split() for r in results[2]]
    again = Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    for r, w, (_, removed, _, _) in zip(results[2], words, brute_repeats([r.text for r in results[2]]), strict=True):
        if any(again[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50)):
            continue  # see test_repeated_passages_by_bytes_and_by_words
        if not removed:
            assert after[r.doc_id] == r
        elif r.doc_id in after:
            new = after[r.doc_id]
            assert 0 <= len(r.text.encode()) - removed - len(new.text.encode()) + 12 <= 12 + 12 and new.n_chars == len(new.text)


def test_mixing(results):
    words = lambda t: len(mixing.re.findall(mixing.WORD, t or ""))
    size, taken = Counter(), Counter()
    for r in results[3]:
        size[r.source] += words(r.text)
    for r in results[4]:
        taken[r.source] += words(r.text)
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size))}
    full, total = set(), sum(size.values())
    for _ in size:
        share = (total - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        full |= {s for s in size if s not in full and weight[s] * share > 3 * size[s]}
    for s in size:
        assert abs(taken[s] - (3 * size[s] if s in full else weight[s] * share)) <= 0.03 * total / len(size)


def test_encoding(results):
    coder = bpe.Bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    expected = Counter((r.doc_id, coder.encode(r.text or "")) for r in results[4])
    assert Counter((r.doc_id, bytes(r.ids)) for r in results[5]) == expected


def test_run(spark, results):
    got = corpus_pipeline.run(spark, D).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == Counter((r.doc_id, r.ids_sha256) for r in results[5])
    assert neardup.ALIKE == 0.8 and rp.REPEAT == 400


def test_repeated_passages_by_bytes_and_by_words(results):
    raws = [(r.text or "").encode() for r in results[2]]
    seen = Counter(raw[i : i + 400] for raw in raws for i in range(len(raw) - 399))
    spans = [[m.span() for m in rp._WORD.finditer(raw)] for raw in raws]
    words = [raw.split() for raw in raws]
    again = Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    after, short = {r.doc_id: r for r in results[3]}, 0
    for r, raw, at, w in zip(results[2], raws, spans, words, strict=True):
        runs = rp.whole_characters(raw, rp.merged([{"start": i, "end": i + 400} for i in range(len(raw) - 399) if seen[raw[i : i + 400]] > 1]))
        by_words = [{"start": at[k][0], "end": at[k + 50][1]} for k in range(len(w) - 50) if again[tuple(w[k : k + 51])] > 1]
        short += bool(by_words) and not runs
        left = rp.without(raw, rp.merged([*by_words, *({"start": a, "end": b} for a, b in runs)])).decode()
        if left.strip() or left == (r.text or ""):
            assert (after[r.doc_id].text or "") == left and (after[r.doc_id].n_chars == len(left) or left == r.text)
        else:
            assert r.doc_id not in after
    assert short > 0


NAMES = ["_own", "_key", "spans", "_i", "_h", "_id", "_hash", "_taken", "_size", "_node", "row", "id", "hash", "taken", "size", "node", "words", "word_spans", "label", "toxic", "grade", "class_id", "h", "z", "start", "n_tokens", "count", "source_size", "target", "text_hash"]


@pytest.mark.parametrize("k", range(4))
def test_other_columns_may_have_any_name(spark, k):
    rows = [(i, f"text {i} of {i * 7} words in a row {i % 5}", "en", "s", 9, *[f"{n}{i}" for n in NAMES]) for i in range(40)]
    rows += [(None, None, None, None, None, *[None] * len(NAMES)), (41, "", "en", None, 0, *["x"] * len(NAMES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, schema), D)
    assert out.columns == [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]
    for r in out.collect():
        if r.doc_id is not None and r.doc_id < 41:
            assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES]
