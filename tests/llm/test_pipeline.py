"""Each stage of the pipeline, on what the one before kept, against brute force; and registered queries against their SQL."""

import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from fathom import llm
from fathom.llm import language_id, line_dedup
from fathom.llm._common import stored

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and the rows of each stage, as pandas tables; and the documents' table."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [df.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        df = stored(stage(spark, df, SMALL))
        tables.append(df.toPandas())
    return tables


def test_stages_return_the_columns_of_documents(stages):
    assert all(list(t.columns) == list(stages[0].columns) for t in stages[1:5])


def test_language_stage_drops_only_rejected_documents(spark, stages):
    before, after = stages[0], stages[1]
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = {r.doc_id: r.score for r in language_id.predict(documents, language_id.fit(documents), "doc_id").collect()}
    letters = {i for i, t in zip(before.doc_id, before.text, strict=True) if t and any(c.isalpha() for c in t)}
    assert set(after.doc_id) == {i for i in letters if scores[i] >= language_id.MIN_SCORE}
    assert len(after) >= 0.95 * len(letters)


def test_language_stage_changes_what_follows(spark):
    """Random letters, hex digits and languages that weren't learned don't reach the later stages; the documents do."""
    rng = np.random.default_rng(3)
    letters = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(n)) for n in (5, 40, 200)]
    odd = [*letters, " ".join(f"{x:016x}" for x in rng.integers(0, 2**62, 40)), "Съешь же ещё этих мягких французских булок да выпей чаю. " * 5, "敏捷的棕色狐狸跳过懒狗，天气很好。" * 5]
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(10**9 + i, text, None, "src0", len(text)) for i, text in enumerate(odd)]
    both = documents.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r[0] for r in language_id.filtered(both).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**9}
    assert kept == {r[0] for r in language_id.filtered(documents).select("doc_id").collect()} and len(kept) > 150


def test_line_stage_against_sql(stages):
    before, after = stages[1], stages[2]
    connection = duckdb.connect()
    connection.register("documents", before)
    rows = connection.execute(line_dedup.ORACLE).fetchall()
    wanted = {i: text for i, n_lines, n_deleted, text in rows if n_deleted == 0 or n_deleted < n_lines}
    assert dict(zip(after.doc_id, after.text, strict=True)) == wanted
    assert all(n == len(t) for n, t, old in zip(after.n_chars, after.text, after.doc_id.map(dict(zip(before.doc_id, before.text, strict=True))), strict=True) if t != old)


def test_near_duplicate_stage_against_brute_force(stages):
    before, after = stages[2], stages[3]
    sets = {}
    for i, text in zip(before.doc_id, before.text, strict=True):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(after.doc_id) == sorted(i for i in sets if find(i) == i) and len(after) < len(before)


def test_mixing_stage_meets_its_targets(stages):
    before, after = stages[3], stages[4]
    size = {i: len(words(t)) for i, t in zip(before.doc_id, before.text, strict=True)}
    source = {i: s for i, s in zip(before.doc_id, before.source, strict=True)}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, float(sum(totals.values())), set(totals)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * totals[s]}
        target |= {s: 3 * totals[s] if s in full else share * weight[s] for s in full or open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken, copies = Counter(), Counter(after.doc_id)
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    assert not {s: (taken[s], t, totals[s]) for s, t in target.items() if abs(taken[s] - t) > 0.02 * t + 3}
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert all(texts[i] == t for i, t in zip(after.doc_id, after.text, strict=True))


def test_packing_stage_against_the_tokenizer(stages):
    before, after = stages[4], stages[5]
    tokenizer, wanted = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, text in zip(before.doc_id, before.text, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        wanted.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(after[columns].itertuples(index=False, name=None)) == wanted
    for _, own in after.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    assert after.sequence_id.nunique() <= 1.02 * -(-after.length.sum() // 1024) + 1


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    wanted = connection.execute(llm.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = llm.QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))
