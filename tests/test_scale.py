"""Letters, memory and plans of larger and odder tables."""

import duckdb

from veritrail import queries as core
from veritrail.functions.dialect import DUCK, SPARK


def test_upper_case_is_letter_by_letter_as_in_sql(spark):
    letters = [chr(i) for i in range(32, 0x2FA20) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1]
    texts = ["Erß", "straße", "ﬁn", "plain", "", "a🙂ß", "".join(letters)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").selectExpr("i", f"{SPARK.upper('x')} AS v").collect()
    con = duckdb.connect()
    for r in got:
        con.execute(f"SELECT {DUCK.upper('x')} FROM (SELECT ? AS x) t", [texts[r["i"]]])
        assert r["v"] == con.fetchall()[0][0]


def test_reader_agrees_with_a_context_in_capitals(spark, tmp_path):
    rows = [(4, 0, "user", "frage eins"), (4, 1, "assistant", "Erß der mann"), (4, 2, "user", "straße"), (4, 3, "assistant", "Erkeitbeß geöö haus")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = core.QUERIES["n10_reader_fallback"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute(core.SQL["n10_reader_fallback"])
    names = [c[0] for c in con.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(con.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_triples_are_not_grouped_by_passage(spark, sf):
    # words met by passage were grouped, and so moved, once for each word of each triple.
    for name in ("l9_retrieval", "l7_seeds"):
        plan = plan_of(core.QUERIES[name](spark, sf))
        assert not any("Aggregate [pid" in line and "dl" in line for line in plan.splitlines())


def test_repeated_triples_and_null_keys(spark, sf, tmp_path):
    # F16 and what shares its step: grouped by keys; a null key is an empty name.
    for name in ("region", "nation", "part"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, 3), (None, 3), (1, 3)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(None, 3), (2, 3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (2, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 2), (1, 1, 2), (None, 1, None), (3, None, 2)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("region", "nation", "part", "customer", "supplier", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("l2_edges", "l4_undirected", "l6_strings", "l8_two_hops", "l10_nodes", "l12_distances"):
        got = core.QUERIES[name](spark, str(tmp_path))
        con.execute(core.SQL[name])
        names = [c[0] for c in con.description]
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(con.fetchall(), key=repr), name


def test_distances_read_only_edges_of_their_fronts(spark, sf):
    # all triples were written as sides before the first round.
    assert "lineitem" not in plan_of(core.QUERIES["l13_gaps"](spark, sf)) and "l_partkey" not in plan_of(core.QUERIES["l13_gaps"](spark, sf))
    assert "l_partkey" not in plan_of(core.QUERIES["l17_repair"](spark, sf))


def test_quotes_of_odd_texts(spark, tmp_path):
    # the answer was searched anew for every sentence; the plan now has no lambda over sentences.
    nine = "a b c d e f g h"
    texts = [None, "", "short. text", f"{nine} iii. x. iii", f"  x. {nine}", f"{nine} i.j k. l", f"zz i9 q. {nine[:11]} i9", "\t a b c. d e f g h b. c", f"{nine} ..", "." * 20, f"{nine} ß🙂. 🙂 ß🙂", f"x.\n{nine}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = core.QUERIES["t32_quotes"](spark, str(tmp_path))
    assert "lambda" not in plan_of(got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(core.SQL["t32_quotes"])
    assert sorted((r["doc_id"], r["quote"]) for r in got.collect()) == sorted(con.fetchall())


def test_pairs_of_an_order_are_made_without_a_join(spark, tmp_path):
    # F17
    rows = [(1, 5, 9), (1, 4, 9), (1, 4, 8), (1, 4, 8), (1, 6, None), (2, None, 1), (2, 3, 1), (None, 1, 1), (None, 2, 1), (3, 1, None), (3, 2, None), (4, 7, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/part.parquet")
    got = core.QUERIES["f11_endpoints"](spark, str(tmp_path))
    assert "Join" not in plan_of(got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute(core.SQL["f11_endpoints"])
    assert sorted((r["qid"], r["a"], r["b"], r["linked"]) for r in got.collect()) == sorted(con.fetchall())


def test_names_link_without_a_join_on_common_words(spark, tmp_path):
    # every two names with a word in common met.
    long = "x" * 40
    texts = [None, "", "alpha beta gamma", "alpha beta gamma d", "beta alpha gamma", "lpha beta gam", "the alpha beta gamma", "alpha", "alphas", "alpha alpha beta", f"{long} {long} b", f"{long} {long} b cc", f"b {long} {long}", f"{long} {long[:35]} b", "ab cd ef gh", "ab cd ef", "b cd e", "cd", "alpha beta", "alpha, beta! gamma", "oak elm ash dd", "lpha beta gam " + "z" * 30, "ash fir yew " + "z" * 40, "yew ash fir", f"q {long} {long} zz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = core.QUERIES["f8_fuzzy"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(core.SQL["f8_fuzzy"])
    names = [c[0] for c in con.description]
    want = sorted(con.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want and {r[names.index("tier")] for r in want} == {1, 2, 3}
    assert not any(line.lstrip(" +-:").startswith("Join Inner, (u#") for line in plan_of(got).splitlines())


def test_readers_get_bounded_texts(spark):
    # F5, F6, F8, F12, F15: a batch of 10,000 rows of any length became Python texts at once.
    from veritrail.operators import reader

    def sizes(question, evidence):
        return __import__("pandas").DataFrame({"answer": [str(sum(len(e or "") for e in evidence))] * len(question), "confidence": 0.0})

    rows = spark.range(400).selectExpr("id", "concat('q', id) AS question", "CASE WHEN id % 50 = 0 THEN null WHEN id = 7 THEN repeat('y', 5000000) ELSE repeat('x', 100000) END AS evidence", "array(id) AS kept")
    got = reader.read(rows.coalesce(1), sizes).select("id", "answer", "kept").collect()
    assert sorted(r["id"] for r in got) == list(range(400)) and all(r["kept"] == [r["id"]] for r in got)
    assert max(int(r["answer"]) for r in got) == 5_000_000 and sorted({int(r["answer"]) for r in got})[-2] <= reader.READ_CHARACTERS


def test_alternatives_of_repeated_documents_without_a_join(spark, tmp_path):
    # answers were normalized once for each side of a self-join.
    rows = [(1, "One two three four", "en", "web"), (2, "a. b", "de", "web"), (2, "c d e f", None, "web"), (3, None, "en", "x"), (4, "same same same", "same", "x"), (None, "k l m", "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = core.QUERIES["n16_alternatives"](spark, str(tmp_path))
    assert "Join" not in plan_of(got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(core.SQL["n16_alternatives"])
    assert len(got.collect()) == len(want := con.fetchall()) and {(r["qid"], r["norm"]) for r in got.collect()} == {x[:2] for x in want}


def test_components_of_many_slices(spark, monkeypatch):
    # any graph shrinks from round to round, however its edges fall into slices.
    import random

    from veritrail.operators import components as c

    monkeypatch.setattr(c, "SLICE_EDGES", 40)
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(1000, 1200)]
    star = [(i, 5000) for i in range(4900, 5100)]
    loose = [(rng.randrange(-300, 0), rng.randrange(-300, 0)) for _ in range(160)]
    edges = [*path, *path[:50], *star, *loose, (7, 7), (None, 8), (1000, None), (None, None), (2**62, -(2**62))]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = c.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, root(x)) for x in parent)
    assert c.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_components_write_little_for_each_edge(spark, sf):
    # every edge was checkpointed in both directions, and all of them moved again in each round.
    from pathlib import Path
    from urllib.parse import urlparse

    from veritrail.operators import components as c

    c.cut(spark.range(1))
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    core.QUERIES["l14_components"](spark, sf).collect()
    assert size() - before < 20 * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_nearest_vectors_block_by_block(spark, tmp_path, monkeypatch):
    # each pair of vectors was a row, multiplied by a lambda.
    import random

    from veritrail.operators import nearest as m

    for name, size in (("BLOCK", 300), ("ASKED_BLOCK", 20), ("_CELLS", 50), ("_PAIRS", 7)):
        monkeypatch.setattr(m, name, size)
    rng = random.Random(5)
    some = lambda: [rng.choice((-2.0, -1.0, 0.0, 1.0, 3.0)) for _ in range(4)]
    rows = [(i, some()) for i in range(-300, 520)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(600, 720)]
    rows += [(100, some()), (101, some()), (101, some()), (200, some()), (None, [1.0, 2.0, 3.0, 4.0]), (None, some()), (750, None), (751, [0.0] * 4), (800, [0.0] * 4), (801, [0.0] * 4), (900, some()), (1000, some())]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    spark.createDataFrame([*rows, (40, [float("nan"), 1.0, 2.0, 3.0]), (41, [float("inf"), 1.0, 2.0, 3.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    for folder in ("a", "b"):
        got = core.QUERIES["f9_embeddings"](spark, f"{tmp_path}/{folder}")
        assert "Join" not in plan_of(got)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{folder}/embeddings.parquet/*.parquet'")
        con.execute(core.SQL["f9_embeddings"])
        names = [c[0] for c in con.description]
        want = con.fetchall()
        assert len(want) > 20 and sorted((repr(tuple(r[c] for c in names)) for r in got.collect())) == sorted(map(repr, want)), folder


def test_cosines_are_rounded_as_in_sql(spark):
    import numpy as np

    from veritrail.operators.nearest import _units

    x = np.array([k / 100_000 + e for k in range(75_000, 76_000) for e in (0, 1e-16, -1.2e-16, 1e-9)] + [1.0, 1.0000000000000002, 0.99995])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("round(x, 4)").collect()]
    assert (_units(x) / 10_000).tolist() == want and np.isinf(_units(np.array([np.nan])))[0]


def test_no_vectors(spark):
    from veritrail.operators.nearest import nearest

    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [None, 1.0]), (4, []), (5, None)], "vec_id long, embedding array<float>")
    asked = vectors.withColumnRenamed("vec_id", "qid")
    assert sorted(map(tuple, nearest(asked, vectors, 3, 0.75).collect())) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert nearest(asked.limit(0), vectors, 3, 0.75).count() == 0 and nearest(asked, vectors.limit(0), 3, 0.75).count() == 0
