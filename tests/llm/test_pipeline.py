"""The corpus pipeline, end to end, against plain Python on a small corpus."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from claimloom.llm import decontaminate, secrets, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, _key string, key long, hits int"


def words(rng, n, vocab):
    return [rng.choice(vocab) for _ in range(n)]


def corpus():
    rng = random.Random(31)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    bench = [(i, " ".join(words(rng, 30, vocab))) for i in range(5)]
    texts, labels = {}, []
    for i in range(240):
        w = words(rng, 120, vocab)
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewort", "grimslur", "snarkfoul"]))
        labels.append((i, 1, int(i % 4 == 0)))
        texts[i] = " ".join(w)
    for i in range(1, 60, 4):  # near copies: one word in a hundred and twenty, or cut at the end
        w = texts[i].split()
        if i % 8 == 1:
            w[60] = "changed"
        texts[300 + i] = " ".join(w if i % 8 == 1 else w[:-12])
    for i in (2, 6, 10):
        texts[i] += " " + bench[i % 5][1] + " end."
    texts[400] = bench[3][1]
    texts[401] = "here password = hunter22xyz and token: Abcdefgh1234567890Abcdefgh1234567890 " + " ".join(words(rng, 40, vocab))
    texts |= {500: None, 501: "", 502: texts[3], 503: "  ", 504: "é" * 3000, 505: " ".join(words(rng, 9000, vocab))}
    return texts, labels, bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    texts, labels, bench = corpus()
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", f"s{i % 7}", None if t is None else len(t), f"k{i}", "own", i, 7) for i, t in texts.items()]
    rows.append(rows[5])  # a row twice
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, labels, bench


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts):
    """Least id of each group of texts that are equal but for case and white space or share 0.8 of their shingles."""
    ids = sorted(texts)
    sets, root = {i: shingles(texts[i]) for i in ids}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if not a and not b or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}


def without_items(text, bench, k=10):
    """Text without words that lie in a window of k words of an item; None if more than half of the words do."""
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    w = [m[0] for m in found]
    windows = {tuple(t.split()[i : i + k]) for _, t in bench for i in range(len(t.split()) - k + 1)}
    hit = sorted({i + j for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows for j in range(k)})
    if len(hit) * 2 > len(w):
        return None
    out, at, runs = "", 0, []
    for i in hit:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    for a, b in runs:
        out, at = out + text[at : found[a].start()], found[b].end()
    return out + text[at:] if text is not None else None


def test_pipeline_against_plain_python(spark, tables):
    from tokenizers import Tokenizer

    import public_tokenizers

    folder, texts, labels, bench = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
        for r in seen[name]:  # columns with names of all sorts keep their values
            assert (r["row_key"], r["_key"], r["key"], r["hits"]) == (f"k{r['doc_id']}", "own", r["doc_id"], 7)
    toxic = {i for i, _, y in labels if y}
    left = [r["doc_id"] for r in seen["toxicity"]]
    assert not toxic & set(left) and len(left) == len(texts) + 1 - len(toxic)
    kept = near_groups({i: texts[i] for i in left})
    assert sorted(r["doc_id"] for r in seen["simhash_near_dedup"]) == sorted(kept)
    want = {}
    for i in kept:
        t = without_items(texts[i], bench)
        if t is not None or texts[i] is None:
            want[i] = t
    assert {r["doc_id"]: r["text"] for r in seen["decontamination"]} == want and 400 not in want and not any(b in (t or "") for t in want.values() for _, b in bench)
    masked = {r["doc_id"]: r["text"] for r in seen["secret_scan"]}
    assert set(masked) == set(want) and masked[401].startswith("here [SECRET] and [SECRET] ")
    assert {i: t for i, t in masked.items() if i != 401} == {i: t for i, t in want.items() if i != 401}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in seen["secret_scan"])

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, by = corpus_pipeline.run(spark, folder).collect(), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(masked)
    for i, pieces in by.items():
        ids, at = np.array(tok.encode(masked[i] or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)


def test_stages_on_empty_tables(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_stages_keep_columns_that_look_like_working_names(spark):
    rows = spark.createDataFrame([(1, "token = abcdefgh " + "w " * 30, "s", "a", "b", "c", "d", "e"), (2, None, None, "a", "b", "c", "d", "e")], "doc_id long, text string, source string, row_key string, row_text string, row_spans string, row_cut string, row_drop string")
    bench = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (simhash.keep_one(rows), secrets.redact(rows), decontaminate.remove_spans(rows, bench)):
        assert out.columns == rows.columns and {tuple(r)[3:] for r in out.collect()} == {("a", "b", "c", "d", "e")} and out.count() == 2
