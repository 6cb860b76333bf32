"""Every registered operator and the pipeline over tables with nulls, blanks, repeated rows, long texts and clashing columns, and over empty ones."""

import hashlib
from collections import Counter
from datetime import datetime, timedelta

import pytest

import __spark_entry__

LONG = "\n".join(" ".join(f"word{(i * j) % 977}" for j in range(40)) for i in range(1500))
#: Extra columns take names that operators use inside.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long, `a.b` string, _n long"
PAGES = "page_id long, url string, html string, rule string, host string"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind int, at string, n long, batch int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, late string, part int, cell long"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score double, rank int"
TEXTS = [None, "", " \n\t ", "one", LONG, LONG, "It is a short line of text.\n" * 30, "MIT license", "!!! 123"]
NAMES = [k for k in __spark_entry__.queries() if k == "pipeline" or (k.startswith("op") and k[2].isdigit())]
PER_ROW = [k for k in NAMES if k.split("_")[0] in ("op2", "op3", "op4", "op5", "op6", "op8", "op9", "op12")]
DAY = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), 1, 2, "x", None) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[4], rows[0], (None, "a text without an id", "en", "s", 20, 1, 2, "x", None), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    urls = ["http://a.com/x", None, "", "://", "http://", "x", "http://a.com/x"]
    pages = [(i, u, None, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], None, "x", "y"), (None, None, None, None, None)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{path}/pages.parquet")
    vectors = [(0, [1.0, 2.0], 1, 0.5, 1), (0, [1.0, 2.0], 1, 0.5, 1), (1, [1.0, 2.0], None, None, None), (2, None, 1, 0.5, 1), (20, [float("nan"), 1.0], 1, 0.5, 1), (None, [1.0, 1.0], 1, 0.5, 1), (40, [0.0, 0.0], 1, 0.5, 1), (3, [], 1, 0.5, 1)]
    spark.createDataFrame(vectors, EMBEDDINGS).write.parquet(f"{path}/embeddings.parquet")
    # Of client 5: two clicks at one time, one repeated, one without an id, one without an arrival; others lack a client or a time.
    clicks = [(1, DAY, DAY, 5), (2, DAY, DAY, 5), (2, DAY, DAY, 5), (None, DAY - timedelta(hours=1), DAY, 5), (4, DAY - timedelta(hours=2), None, 5), (6, None, DAY, 5), (7, DAY, DAY, None), (8, None, None, None)]
    spark.createDataFrame([(*c, 1, "x", 2, 3) for c in clicks], CLICKS).write.parquet(f"{path}/clicks.parquet")
    sales = [(1, 5, DAY, DAY), (1, 5, DAY, DAY), (2, 5, DAY - timedelta(minutes=30), DAY), (None, 5, DAY - timedelta(hours=3), None), (4, None, DAY, DAY), (5, 5, None, DAY), (6, 9, DAY, DAY)]
    spark.createDataFrame([(*x, "y", 1, 2) for x in sales], SALES).write.parquet(f"{path}/sales.parquet")
    return path


@pytest.fixture(scope="module")
def wide_dir(spark, tmp_path_factory):
    """Vectors of 64 components, with others, repeated rows and one without an id."""
    path, wide = str(tmp_path_factory.mktemp("wide")), [1.0] * 64
    vectors = [(50, wide), (50, wide), (51, [-1.0] * 64), (None, wide), (52, [*wide[1:], None]), (53, [*wide[1:], float("inf")]), (54, wide[1:]), (55, None), (56, [])]
    spark.createDataFrame([(*v, 1, 0.5, 1) for v in vectors], EMBEDDINGS).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "embeddings", "clicks", "sales"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert __spark_entry__.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", [k for k in NAMES if not k.startswith("op13")])
def test_odd_tables_give_rows(spark, odd_dir, name):
    rows = __spark_entry__.queries()[name](spark, odd_dir).collect()
    assert rows and rows[0].__fields__


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_comes_back_for_each_row(spark, odd_dir, name):
    key, table = ("page_id", "pages") if name.startswith("op6") else ("doc_id", "documents")
    wanted = Counter(r[0] for r in spark.read.parquet(f"{odd_dir}/{table}.parquet").select(key).collect())
    assert Counter(r[key] for r in __spark_entry__.queries()[name](spark, odd_dir).collect()) == wanted


def test_vectors_of_several_dimensions(spark, odd_dir):
    found = __spark_entry__.queries()["op1_topk_search"](spark, odd_dir).collect()
    # Ids 0, 0, 1, 3 and 40 take part; 0 and 40 ask, and the zero vectors 3 and 40 score 0 with all.
    assert [(r.rank, r.vec_id, r.score) for r in found if r.query_id == 0] == [(1, 1, 64 * 64 * 5), (2, 3, 0), (3, 40, 0)]
    assert [(r.rank, r.vec_id, r.score) for r in found if r.query_id == 40] == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 3, 0)]


def test_attribution_of_odd_rows(spark, odd_dir):
    """Repeated sales have a row each, a missing id is no id, equal times go to the larger id, and rows without a client or a time go."""
    found = Counter((r.sale_id, r.late, r.click_id, r.n_clicks) for r in __spark_entry__.queries()["op11_attribution"](spark, odd_dir).collect())
    assert found == Counter({(1, False, 2, 4): 2, (2, False, None, 2): 1, (None, False, None, 0): 1, (6, False, None, 0): 1})


def test_encoding_of_odd_rows(spark, odd_dir):
    found = __spark_entry__.queries()["op12_byte_bpe"](spark, odd_dir).collect()
    none, long = hashlib.sha256(b"").hexdigest(), hashlib.sha256(LONG.encode()).hexdigest()
    assert sum((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, none, none) for r in found) == TEXTS.count(None) + TEXTS.count("") + 2
    assert sum(r.decoded_sha256 == long for r in found) == 3


def test_clusters_of_odd_vectors(spark, wide_dir):
    """Only whole vectors of 64 components take part; repeated rows and those without an id do."""
    found = __spark_entry__.queries()["op13_centroid_clusters"](spark, wide_dir).collect()
    assert Counter((r.vec_id, r.distance, r.inertia) for r in found) == Counter({(50, 0, 0): 2, (51, 0, 0): 1, (None, 0, 0): 1})
