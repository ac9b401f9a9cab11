"""Unit cases of the catalogue operators."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.functions import uniform
from catalith.functions.linalg import project, spectrum
from catalith.functions.ranks import in_ranges, quantiles, running
from catalith.operators import audit, binding, contract, digest, evaluate, features, measure, neighbors, population, records, spatial, split, uncertainty
from catalith.sources import files, ledger, scratch


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_fixed_width_fields_and_markers(spark):
    f = files.Field
    assert files.fixed_width(lines(spark, "ABC 12  "), [f("a", 1, 3), f("b", 5, 6), f("c", 8, 9)]).first() == ("ABC", "12", None)
    assert files.fixed_width(lines(spark, "---"), [f("a", 1, 3)], ("", "---")).first() == (None,)


def test_csv_numbers_nulls_and_header(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,value\n1,99\n\n2,\n")
    rows = files.read_csv(spark, str(p), {"id": "key", "value": "v"}).orderBy("source_row").collect()
    assert [(r["source_row"], r["key"], r["v"]) for r in rows] == [(1, "1", "99"), (2, "2", None)]
    with pytest.raises(files.SourceError):
        files.read_csv(spark, str(p), {"id": "key", "other": "v"})


def test_line_numbers_over_many_splits(spark, tmp_path):
    p = tmp_path / "long.txt"
    p.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        wrong = files.numbered_lines(spark, str(p)).where(F.col("value") != F.concat(F.lit("line "), F.col("source_row"))).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert wrong == 0


def test_typed_load_preflight_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    with pytest.raises(Exception):
        files.typed(df, {"b": "int"}).collect()
    assert files.rejects(df, {"a": "int", "b": "int"}).first()["bad_columns"] == ["b"]
    with pytest.raises(files.SourceError, match="missing columns: c, d"):
        files.require_columns(df, ["d", "a", "c"])
    p = tmp_path / "x.txt"
    p.write_text("a\nb\n")
    sha = files.file_digests(spark, str(p)).first()["sha256"]
    files.preflight(spark, str(p), lines(spark, "a", "b"), sha, 2)
    with pytest.raises(files.SourceError):
        files.preflight(spark, str(p), lines(spark, "a"), sha, 2)
    reg = spark.createDataFrame([("a",)], "code string")
    with pytest.raises(files.SourceError):
        ledger.register(reg, reg)
    assert ledger.register(reg, spark.createDataFrame([("b",)], "code string")).count() == 2
    with pytest.raises(files.SourceError):
        ledger.load_all({"t": (df, 2)}, str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())
    ledger.load_all({"t": (df, 1)}, str(tmp_path / "out"))
    with pytest.raises(Exception):
        ledger.write_once(df, ledger.Publication(spark, str(tmp_path / "out")).tables()["t"])


def sky(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, ra double, dec double")


def test_cross_match_wrap_ties_and_empty(spark):
    ref, tar = sky(spark, (10, 359.9999, 0.0), (20, 359.9999, 0.0)), sky(spark, (30, 0.0001, 0.0))
    got = spatial.ranked(spatial.radius_pairs(ref, tar, 1.0)).orderBy("candidate_rank").collect()
    assert [(r["ref"], r["candidate_rank"], r["candidate_count"], round(r["sep"], 6)) for r in got] == [(10, 1, 2, 0.72), (20, 2, 2, 0.72)]
    assert spatial.radius_pairs(sky(spark, (1, 10.0, 0.0)), sky(spark, (2, 20.0, 0.0), (3, None, 0.0)), 1.0).count() == 0
    with pytest.raises(ValueError):
        spatial.radius_pairs(ref, tar, 0.0)


def test_cross_match_equals_brute_force_at_poles(spark):
    rng = np.random.default_rng(1)
    r = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 360, 200), rng.uniform(89.99, 90, 200)))]
    t = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 360, 200), rng.uniform(89.99, 90, 200)))]
    unit = lambda rows: np.array([(math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))) for _, a, d in rows])
    u, v = unit(r), unit(t)
    sep = np.arctan2(np.linalg.norm(np.cross(u[:, None], v[None]), axis=2), u @ v.T) * 206264.80624709636
    want = {(i, j) for i, j in zip(*np.nonzero(sep <= 5.0))}
    got = {(x["ref"], x["target"]) for x in spatial.radius_pairs(sky(spark, *r), sky(spark, *t), 5.0).collect()}
    assert got == want and want


def test_cone_over_wrap(spark):
    d = sky(spark, (1, 359.5, 0.0), (2, 0.5, 0.0), (3, 1.5, 0.0), (4, 0.0, 1.0))
    assert {r["id"] for r in spatial.cone(d, 0.0, 0.0, 1.0).collect()} == {1, 2, 4}


def test_evidence_multiplies_no_rows(spark):
    p = spark.createDataFrame([(1,), (2,)], "ref long")
    e = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    got = population.has_evidence(p, "ref", [(e, "k"), (e, "k")], "f").orderBy("ref").collect()
    assert [(r["ref"], r["f"]) for r in got] == [(1, True), (2, False)]
    with pytest.raises(ValueError):
        population.apply_policy(p, "any")


def test_audits(spark):
    d = spark.createDataFrame([(1, None), (1, None), (2, 1.0), (None, 2.0)], "k long, v double")
    assert {r["column"]: r["nulls"] for r in audit.null_counts(d).collect()} == {"k": 1, "v": 2}
    assert audit.key_audit(d, ["k"]).first() == (1, 1, 1)
    b = spark.createDataFrame([(0.0, 90.0), (360.0, 0.0), (None, 91.0), (None, 0.0)], "ra double, dec double")
    assert audit.bounds_audit(b, "ra", "dec").first() == (2, 2)


def six(spark):
    rows = []
    for n in range(1, 7):
        mags = [20.0] * 6
        if n > 1:
            mags[n - 2] += n / 10
        rows.append((n, *mags))
    return spark.createDataFrame(rows, "object_id long, u double, g double, r double, i double, z double, y double")


BANDS = list("ugrizy")


def test_six_objects(spark):
    wide = six(spark).select("*", *[F.lit(0.01).alias(f"{b}_err") for b in BANDS])
    bands = [measure.Band(b, b, f"{b}_err") for b in BANDS]
    long = measure.unpivot(measure.require_valid(wide, bands), ["object_id"], bands)
    f = features.build(long, ["object_id"], BANDS)
    assert long.count() == 36 and f.count() == 126
    assert features.coverage(f, wide).where("not complete").isEmpty()
    v = features.vectors(f, ["object_id"], features.names_of(BANDS)[6:])
    assert features.rank_audit(v, 15, 5).rank == 5
    assert features.identity_residual(v, BANDS).first()["residual"] <= 1e-10
    sample = six(spark).select("object_id")
    edges = six(spark).select(F.col("object_id").alias("ref"), (F.col("object_id") + 100).alias("target"), F.lit(1).alias("candidate_rank"), F.lit(1).alias("reference_rank"))
    b = binding.bind(sample, edges, "reciprocal")
    assert b.count() == 12
    binding.require_one_each(b, sample)
    with pytest.raises(ValueError):
        binding.require_one_each(b.where("record_id <> 101"), sample)
    with pytest.raises(ValueError):
        measure.require_valid(wide.withColumn("u_err", F.lit(-1.0)), bands)
    with pytest.raises(ValueError):
        measure.unpivot(wide, ["object_id"], bands, reddening="u")


def test_rank_where_a_gramian_fails(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 100, (3000, 6))
    d = np.array([base[:, i] - base[:, j] for i in range(6) for j in range(i + 1, 6)]).T
    df = spark.createDataFrame([(r.tolist(),) for r in d], "x array<double>").repartition(20)
    s = spectrum(df, "x", 15)
    assert s.rank == 5
    assert np.allclose(s.values, np.linalg.svd(d - d.mean(axis=0), compute_uv=False), rtol=1e-9, atol=1e-6)


def test_split_is_stable_and_exact(spark):
    d = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 300, "a").otherwise("b").alias("c"))
    a = split.stratified_split(d, "c", ["id"], 0.2, 5)
    b = split.stratified_split(d.repartition(7), "c", ["id"], 0.2, 5)
    assert a.exceptAll(b).isEmpty()
    assert {(r["c"], r["split"]): r["n"] for r in split.ledger(a, "c").collect()} == {("a", "test"): 60, ("a", "train"): 240, ("b", "test"): 140, ("b", "train"): 560}
    folds = split.k_folds(d, "c", ["id"], 5, 5)
    assert folds.count() == 1000 and folds.groupBy("c", "fold").count().where("count not in (60, 140)").isEmpty()
    with pytest.raises(ValueError):
        split.stratified_split(d, "c", ["id"], 1.5, 5)
    with pytest.raises(ValueError):
        split.require_unassigned(a)


def test_coordinate_offsets_count_every_object(spark, monkeypatch):
    from catalith.plans import catalogue

    t = spark.createDataFrame([(i, 0.0, 0.0) for i in (35, 70, 105, 1)], "id long, ra double, dec double")
    monkeypatch.setattr(catalogue.fx, "catalogues", lambda spark, sf: (None, t))
    r = catalogue.coordinate_offsets(spark, "").first()
    assert (r["offset_median"], r["above_0"], r["above_1"]) == (0.0, 1, 1) and r["offset_max"] == 0.509


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digest_counts_repeated_rows_once(spark):
    d = spark.range(3000).select(F.lit("a").alias("v"))
    assert digest.table_digest(d, ["v"]).first() == (3000, sha(sha("a") + "x3000"))
    assert digest.table_digest(d.limit(1), ["v"]).first() == (1, sha(sha("a")))
    assert digest.table_digest(d.limit(0), ["v"]).first() == (0, sha(""))
    assert digest.table_digest(d.limit(2999), ["v"]).first()["sha256"] != digest.table_digest(d, ["v"]).first()["sha256"]


def test_digest_tree_is_as_deep_as_the_table_asks_for(spark, monkeypatch):
    assert [digest.depth_for(n) for n in (0, 256, 257, 65_536, 65_537, 10**12)] == [0, 0, 1, 1, 2, 4]
    monkeypatch.setattr(digest, "FAN", 4)  # a deeper tree over few rows
    d = spark.range(600).select((F.col("id") % 500).alias("id"))
    times = {sha(str(i)): 2 if i < 100 else 1 for i in range(500)}
    level = {}
    for row, n in times.items():
        level.setdefault(row[:8], []).append(row + ("x2" if n == 2 else ""))
    level = {k: sha("".join(sorted(v))) for k, v in level.items()}
    for k in (6, 4, 2, 0):
        up = {}
        for key, s in sorted(level.items()):
            up.setdefault(key[:k], []).append(key[k:] + s)
        level = {key: sha("".join(v)) for key, v in up.items()}
    assert digest.depth_for(500) == 4 and digest.table_digest(d, ["id"]).first() == (600, level[""])


def test_digest(spark):
    d = spark.range(500).select("id", (F.col("id") / 7).alias("v"))
    one = digest.table_digest(d, ["id", "v"]).first()
    assert one == digest.table_digest(d.orderBy(F.desc("id")).repartition(9), ["id", "v"]).first()
    assert one != digest.table_digest(d.withColumn("v", F.when(F.col("id") == 3, 0.01).otherwise(F.col("v"))), ["id", "v"]).first()
    with pytest.raises(Exception, match="finite values"):
        digest.table_digest(d.withColumn("v", F.lit(float("nan"))), ["id", "v"])


def test_tables_differ_where_their_trees_do(spark):
    a = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    b = a.where("id <> 17").withColumn("v", F.when(F.col("id") == 99, 1000).otherwise(F.col("v"))).unionByName(a.where("id in (5, 6)"))
    got = sorted(map(tuple, digest.table_difference(a, b, ["id", "v"]).collect()))
    assert got == [(5, 5, 1, 2), (6, 6, 1, 2), (17, 3, 1, 0), (99, 1, 1, 0), (99, 1000, 0, 1)]
    ta, tb = digest.table_tree(a, ["id", "v"]), digest.table_tree(b, ["id", "v"])
    assert {r["key"] for r in digest.differing_nodes(ta, tb).collect()} == {sha(f"{i}\t{v}")[:2] for i, v, *_ in got}
    assert digest.differing_nodes(ta, ta).count() == 0 == digest.table_difference(a, a, ["id"]).count()
    assert digest.table_difference(a.limit(0), a.limit(2), ["id"]).count() == 2


def test_contracts_refuse(spark):
    led = spark.createDataFrame([("s", "split", "x"), ("s", "binding", "")], "sample string, kind string, digest string")
    s = contract.sample_contract(led, ["split", "binding"])
    assert s.first()["missing"] == "binding"
    m = spark.createDataFrame([("train", "a"), ("test", "b")], "split string, target_class string")
    p = contract.population_contract(m, {"train": ["a"], "test": ["a"]})
    assert {r["split"]: r["as_declared"] for r in p.collect()} == {"train": True, "test": False}
    f = contract.feature_contract(spark.createDataFrame([("f", "s", "d")], "feature_set string, sample string, digest string"), led)
    with pytest.raises(contract.ContractError):
        contract.freeze(s, f, p, "plan")
    good = contract.sample_contract(led.withColumn("digest", F.lit("x")), ["split", "binding"])
    with pytest.raises(contract.ContractError):
        contract.freeze(good, f, p, "plan")
    assert contract.freeze(good, f, p.where("as_declared"), "plan").count() == 1
    with pytest.raises(files.SourceError):
        ledger.seal(led, led.where("digest = ''"))


def test_scaling_leaks_nothing(spark):
    d = spark.createDataFrame([(0, 0, [1.0, 5.0]), (1, 0, [3.0, 5.0]), (2, 1, [100.0, 5.0])], "id long, fold int, x array<double>")
    got = {r["id"]: r["s"] for r in evaluate.standardize(d, "x", 2, "s").collect()}
    assert got[2] == [98.0, 0.0] and got[0] == [-99.0, 0.0]
    with pytest.raises(PermissionError):
        evaluate.split_matrix(d, d.withColumn("split", F.lit("test")), "id", "test")


def test_neighbours_and_metrics(spark):
    d = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(30)], "id long, x array<double>, label int")
    n = neighbors.knn(d, d, 3, rows=7)
    assert [r["neighbor"] for r in n.where("query = 5").orderBy("rank").collect()] == [4, 6, 3]
    assert neighbors.overlap(n, n, 3).first()["overlap"] == 1.0
    assert neighbors.trustworthiness(d, n, n, 3).first()["trustworthiness"] == 1.0
    z = neighbors.knn_vote(spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.1)], "query long, neighbor long, distance double"), d)
    assert [(r["label"], r["weight"]) for r in z.collect()] == [(0, 1.0)]


def test_uncertainty_identities(spark):
    long = six(spark).select("object_id", F.lit("u").alias("band"), F.col("u").alias("mag"), F.lit(0.0).alias("mag_err"))
    assert uncertainty.realisations(long, ["object_id"], 3, "s").select("object_id", "mag").distinct().count() == 6
    p = spark.range(50).select("id", (F.col("id") % 2).alias("c"), F.lit(1).alias("ok_a"), F.lit(1).alias("ok_b"))
    r = uncertainty.paired_bootstrap(p, "c", 20, 7).first()
    assert (r["observed"], r["lower"], r["upper"], r["replicates"]) == (0.0, 0.0, 0.0, 20)


def test_records(spark):
    c = records.Catalogue("x", ("f", "n"), "ra", "dec")
    r = records.normalize([(c, spark.createDataFrame([("a", 1, 0.0, 0.0)], "f string, n long, ra double, dec double"))])
    assert r.first()["source_key"] == '["a","1"]'
    with pytest.raises(ValueError, match="not in the registry: x"):
        records.registered(r, spark.createDataFrame([("y",)], "code string"))


def test_csv_quotes_ragged_rows_and_blank_lines(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('"a, the key",b\n"7","x\ny"\n8,"say ""hi"", you"\n')
    rows = files.read_csv(spark, str(p), {"a, the key": "a", "b": "b"}).orderBy("source_row").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "7", "x\ny"), (2, "8", 'say "hi", you')]
    for i, bad in enumerate(("1,2,3", "4", '5,"x\ny",6')):
        q = tmp_path / f"bad{i}.csv"
        q.write_text(f"a,b\n0,0\n{bad}\n")
        with pytest.raises(Exception, match="not 2 cells in row 2"):
            files.read_csv(spark, str(q), {"a": "a", "b": "b"}).collect()
    with pytest.raises(files.SourceError):
        files.read_csv(spark, str(tmp_path / "bad0.csv"), {"a": "a", "c": "b"})
    with pytest.raises(files.SourceError):
        files.read_csv(spark, str(tmp_path / "bad0.csv"), {"a": "a", "b": "b", "c": "c"})
    p = tmp_path / "blank.csv"
    p.write_text("a,b\n" + "".join(f"{i},v\n" + "\n" * (i % 3) for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        wrong = files.read_csv(spark, str(p), {"a": "a", "b": "b"}).where("source_row <> a").count()
        n = files.read_csv(spark, str(p), {"a": "a", "b": "b"}).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (wrong, n) == (0, 2000)


def test_csv_records_over_blocks(spark, tmp_path):
    """Line feeds, blank lines and quotes inside cells, in files cut into blocks anywhere: every record, its number, and many tasks."""
    rng = np.random.default_rng(2)
    want = {}
    for f in range(3):
        p, text, n = tmp_path / f"f{f}.csv", "a,b\n", 0
        for i in range(400):
            b = "".join(rng.choice(["x", "\n", "\n\n", '"', ",", "long " * 9]) for _ in range(int(rng.integers(6)))) if f else f"plain {i}"
            n += 1
            want[f"f{f}.csv", n] = (str(i), b or None)
            quoted = '"' + b.replace('"', '""') + '"' if f else b
            text += f"{i},{quoted}\n" + ("\n" if f == 2 and i % 7 == 0 else "")
        p.write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert files.csv_records(spark, str(tmp_path)).select("source_file").distinct().count() == 3
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = files.read_csv(spark, str(tmp_path), {"a": "a", "b": "b"}).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r["source_file"].rsplit("/", 1)[1], r["source_row"]): (r["a"], r["b"]) for r in rows}
    assert len(rows) == len(want) and got == want
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny\n')
    with pytest.raises(Exception, match="not 2 cells in row 1"):
        files.read_csv(spark, str(tmp_path / "open.csv"), {"a": "a", "b": "b"}).collect()


def test_fixed_width_files_strip_all_white_space(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("AB\t 12 \nC    ---\n")
    f = files.Field
    rows = files.read_fixed_width(spark, str(p), [f("a", 1, 4), f("b", 5, 8)], ("", "---")).orderBy("source_row").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "AB", "12"), (2, "C", None)]


def test_load_is_all_or_nothing(spark, tmp_path):
    one, two, target = spark.range(3).toDF("k"), spark.range(5).toDF("k"), str(tmp_path / "out")
    done = ledger.Publication(spark, target)
    with pytest.raises(files.SourceError, match="5 rows instead of 4"):
        ledger.load_all({"t1": (one, 3), "t2": (two, 4)}, target)
    assert done.tables() == {} and [x.name for x in (tmp_path / "out").iterdir() if "load" in x.name] == []
    assert ledger.load_all({"t2": (two, 5)}, target) == {"t2": 5}  # the failed load is no obstacle, and nothing of it shows
    with pytest.raises(files.SourceError, match="t2; nothing"):
        ledger.load_all({"t1": (one, 3), "t2": (two, 5)}, target)
    assert sorted(done.tables()) == ["t2"]
    assert ledger.load_all({"t1": (one, 3), "t3": (two, 5)}, target) == {"t1": 3, "t3": 5}
    assert (done.read("t1").count(), done.read("t3").count(), len(done.commits())) == (3, 5, 2)
    with pytest.raises(files.SourceError, match="t9 is not published"):
        done.read("t9")


def test_load_that_died_is_not_published(spark, tmp_path, monkeypatch):
    one, target = spark.range(3).toDF("k"), str(tmp_path / "out")
    done = ledger.Publication(spark, target)
    with monkeypatch.context() as m:  # died after its tables were written, before the commit
        m.setattr(ledger.Publication, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            done.load({"t1": (one, 3)})
    assert done.tables() == {}
    assert done.load({"t1": (one.where("k > 0"), 2)}) == {"t1": 2} and done.read("t1").count() == 2
    left = done.recover()
    assert len(left) == 1 and done.recover() == [] and done.read("t1").count() == 2


def test_loads_at_the_same_time(spark, tmp_path, monkeypatch):
    """Two loads find the same next number; one takes the next, unless their tables clash."""
    one, two = spark.range(3).toDF("k"), spark.range(4).toDF("k")
    a, b = (ledger.Publication(spark, str(tmp_path / "out")) for _ in range(2))
    names, first = a._names, []

    def stale(*parts):
        if parts == ("commits",) and not first:
            first.append(names(*parts))
            b.load({"t2": (two, 4)})  # between a's look and its renaming
            return first[0]
        return names(*parts)

    commit = a._commit
    monkeypatch.setattr(a, "_commit", lambda *x: (monkeypatch.setattr(a, "_names", stale), commit(*x)))
    a.load({"t1": (one, 3)})
    assert sorted(a.tables()) == ["t1", "t2"] and len(b.commits()) == 2
    with pytest.raises(files.SourceError, match="already published: t1"):
        b._commit("load-x", {"t1": 1})


def test_sample_is_published_only_as_the_funnel_counts_it(spark, tmp_path):
    rows = [(i, True, i % 2 == 0, i % 5 == 0, i % 7 == 0, False) for i in range(70)]
    p = spark.createDataFrame(rows, "id long, complete boolean, error_qualified boolean, is_focal boolean, is_second boolean, is_third boolean")
    counts = population.publish_members(p, str(tmp_path / "sample"))
    assert counts["matched"] == 70 and counts["labelled"] == counts["rows"] == spark.read.parquet(str(tmp_path / "sample")).count()
    assert counts == population.funnel(p).first().asDict() | {"rows": counts["rows"]}
    wrong = spark.range(1).select(F.lit(3).alias("labelled"), F.lit(2).alias("rows")).first().asDict()
    with pytest.raises(ValueError, match="2 members, but the funnel labels 3"):
        population.require_labelled(wrong)


def test_manifest_runs_and_stage_counts(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("a\n")
    m = {(r["kind"], r["name"]): r["value"] for r in ledger.manifest(spark, "r1", {"in": str(p)}, {"seed": 7, "bands": ["u"]}, {"rows": 2}, {"rows": "ab"}).collect()}
    assert m["setting", "bands"] == '["u"]' and m["count", "rows"] == "2" and m["digest", "rows"] == "ab"
    assert '"n_bytes":2' in m["input", "in"] and "87428fc522803d31065e7bce3cf03fe475096631e5e07bbd7a0fde60c4cf25c7" in m["input", "in"]
    s = spark.createDataFrame([("a", "running", 1), ("a", "complete", 2), ("b", "complete", 1), ("b", "failed", 3)], "run string, status string, at long")
    assert [r["run"] for r in ledger.complete_runs(s, spark.createDataFrame([("a",), ("b",), ("c",)], "run string")).collect()] == ["a"]
    assert [tuple(r) for r in ledger.stage_counts(spark, "a", "load", {"x": 3}).collect()] == [("a", "load", "x", 3)]


def test_measurements_that_exist_are_refused(spark):
    old, new = spark.createDataFrame([("des", "g", True)], "c string, m string, k boolean"), spark.createDataFrame([("des", "r", True)], "c string, m string, k boolean")
    measure.require_absent(old, new, ["c", "m", "k"])
    with pytest.raises(ValueError):
        measure.require_absent(old, old, ["c", "m", "k"])


def test_cross_match_copies_either_side(spark):
    few, many = sky(spark, (1, 10.0, 0.0)), sky(spark, *((i, 10.0 + i * 1e-4, 0.0) for i in range(-20, 20)))
    a = {(r["ref"], r["target"]) for r in spatial.radius_pairs(few, many, 1.0).collect()}
    b = {(r["target"], r["ref"]) for r in spatial.radius_pairs(many, few, 1.0).collect()}
    assert a == b and len(a) == 5


def brute_neighbours(base, queries, k):
    """query -> [(neighbor, distance)] by all distances; ties by id."""
    ids, y = np.array([i for i, _ in base]), np.array([v for _, v in base], float)
    out = {}
    for i, v in queries:
        d = np.sqrt(((y - np.array(v)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), round(float(d[j]), 9)) for j in order]
    return out


def found_neighbours(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["neighbor"], round(r["distance"], 9)))
        assert r["rank"] == len(out[r["query"]])
    return out


def points(spark, rows):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "id long, x array<double>")


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 4
    rows = [(i, centres[i % 30] + rng.normal(size=8)) for i in range(900)] + [(2000 + i, centres[0]) for i in range(40)]  # copies, a crowded cell
    grid = [(i, (i // 12, i % 12)) for i in range(144)]  # ties everywhere
    line = [(i, (0.0 if i < 150 else i,)) for i in range(200)]  # most rows in one place
    for data, k in ((rows, 5), (grid, 6), (line, 4)):
        p = points(spark, data)
        assert found_neighbours(neighbors.knn(p, p, k, rows=40, cell=20)) == {q: n for q, n in brute_neighbours(data, data, k).items() if n}
    few = [(9000 + i, v) for i, v in [*rows[:20], *rows[-3:]]]
    assert found_neighbours(neighbors.knn(points(spark, rows), points(spark, few), 5, cell=30)) == brute_neighbours(rows, few, 5)
    none = points(spark, rows).limit(0)
    assert neighbors.knn(none, none, 5).count() == 0 == neighbors.knn(points(spark, rows), none, 5).count()
    nulls = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (None, [0.5]), (3, None)], "id long, x array<double>")
    assert found_neighbours(neighbors.knn(nulls, nulls, 3)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}


def test_neighbours_compare_little_where_data_have_a_shape(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2)) for i in range(4000)]
    p = points(spark, rows)
    e = neighbors.effort(p, p, 5, cell=40).first()
    assert e["pairs"] == 16_000_000 and e["compared"] < e["pairs"] / 20
    assert found_neighbours(neighbors.knn(p, p, 5, cell=40)) == brute_neighbours(rows, rows, 5)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_reach_their_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id AS id", "CAST(embedding AS ARRAY<DOUBLE>) AS x")
    exact = neighbors.knn(e, e, 5)
    assert neighbors.recall(neighbors.knn_approximate(e, e, 5), exact).first()["recall"] >= 0.9


def test_approximate_neighbours_by_probes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 4
    rows = [(i, centres[i % 30] + rng.normal(size=8)) for i in range(1500)] + [(1500 + i, centres[0]) for i in range(3)]
    p = points(spark, rows)
    exact = neighbors.knn(p, p, 5)
    assert neighbors.recall(neighbors.knn_approximate(p, p, 5, probes=8, rows=300, centres=40), exact).first()["recall"] >= 0.9
    assert neighbors.recall(neighbors.knn_approximate(p, p, 5, probes=12, rows=300, centres=12), exact).first()["recall"] == 1.0
    none = p.limit(0)
    assert neighbors.knn_approximate(none, p, 5).count() == 0 == neighbors.knn_approximate(p, none, 5).count()


def test_ranks_are_counted_by_cells(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.round(rng.normal(size=3) * (1 + i % 4), 1)) for i in range(400)] + [(500 + i, (0.1, 0.1, 0.1)) for i in range(30)]
    p = points(spark, rows)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    pairs = [(int(a), int(b)) for a, b in rng.choice(ids, (300, 2)) if a != b]
    pairs = sorted(set(pairs + [(500, 501), (510, 529), (529, 500)]))
    asked = spark.createDataFrame(pairs, "query long, neighbor long")
    at, n = {int(i): j for j, i in enumerate(ids)}, len(ids)
    for size in (20, 1000):
        got = {(r["query"], r["neighbor"]): r["rank"] for r in neighbors.source_ranks(p, asked, rows=64, cell=size).collect()}
        assert set(got) == set(pairs)
        for (a, b), rank in got.items():
            d = np.sqrt(((x - x[at[a]]) ** 2).sum(axis=1))
            order = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != a]
            assert rank == order.index(b) + 1
    compared = neighbors.source_ranks(p, asked, cell=20).agg(F.sum("compared")).first()[0]
    assert compared < len(pairs) * n / 2


def test_bootstrap_of_another_metric(spark):
    rows = [(i, i % 2, int(i % 3 > 0), int(i % 5 > 0), int(i % 3 > 0 and i % 2 == 1), int(i % 5 > 0 and i % 2 == 1)) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, y int, a int, b int, ta int, tb int")

    def contamination(total):
        return (1 - total("ta") / total("a")) - (1 - total("tb") / total("b"))

    r = uncertainty.paired_bootstrap(d, "y", 60, 7, columns=("a", "b", "ta", "tb"), metric=contamination).first()
    share = lambda k, t: 1 - sum(x[t] for x in rows) / sum(x[k] for x in rows)
    assert abs(r["observed"] - (share(2, 4) - share(3, 5))) < 1e-12 and r["replicates"] == 60 and r["lower"] <= r["observed"] <= r["upper"]


def test_standardize_does_not_cancel(spark):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=40)
    d = spark.createDataFrame([(i, i % 4, [float(v)]) for i, v in enumerate(x)], "id long, fold int, x array<double>")
    for r in evaluate.standardize(d, "x", 1).collect():
        rest = np.array([v for i, v in enumerate(x) if i % 4 != r["fold"]])
        assert abs(r["scaled"][0] - (x[r["id"]] - rest.mean()) / rest.std()) < 1e-4


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(4)
    cases = [np.exp(rng.normal(size=3000) * 50), rng.integers(-5, 5, 2001).astype(float), np.concatenate([np.zeros(900), rng.normal(size=100) * 1e-300, [1e308, -1e308]]),
             1 + rng.random(2500) * 1e-12, np.array([2.5]), np.repeat([1.0, 3.0], 700)]
    shares = [0.025, 0.5, 1.0]
    for x in cases:
        d = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "y double")
        got = quantiles(d, "y", shares, last=200, parts=64)
        for g, s in zip(got, shares, strict=True):
            assert math.isclose(g, np.quantile(x, s), rel_tol=1e-12, abs_tol=1e-320)
    assert quantiles(spark.createDataFrame([(None,)], "y double"), "y", [0.5]) == [None]


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"s{int(rng.integers(3))}" if i % 7 else None, float(np.exp(rng.normal() * 9)) * (i % 5 > 0)) for i in range(1500)]  # skewed, with ties
    d = in_ranges(spark.createDataFrame(rows, "id long, s string, x double"), [F.col("x"), F.col("id")], 100)
    assert d.select("range").distinct().count() > 5
    for by, down in (([], False), (["s"], True)):
        order = [F.desc("x"), F.desc("id")] if down else [F.asc("x"), F.asc("id")]
        got = {r["id"]: (r["n"], r["all_n"]) for r in running(d, "range", order, {"n": F.lit(1)}, by, down).collect()}
        for s in {r[1] for r in rows} if by else [0]:
            own = sorted((r for r in rows if not by or r[1] == s), key=lambda r: (r[2], r[0]), reverse=down)
            for k, r in enumerate(own, 1):
                assert got[r[0]] == (k, len(own))


def test_curve_of_skewed_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(float(np.exp(-abs(rng.normal()) * 30)) if i % 3 else 0.5, int(rng.integers(2))) for i in range(2000)]
    got = {r["score"]: (r["tp"], r["fp"]) for r in evaluate.pr_curve(spark.createDataFrame(rows, "score double, target int"), rows=150).collect()}
    score, target = np.array(rows).T
    assert len(got) == len(set(score))
    for s, (tp, fp) in got.items():
        assert (tp, fp) == ((target[score >= s] == 1).sum(), (target[score >= s] == 0).sum())


def test_split_over_many_ranges(spark):
    rows = spark.createDataFrame([(i, "a" if i % 9 else None) for i in range(700)], "id long, s string")
    one, many = ({r["id"]: (r["place"], r["stratum_size"]) for r in split.hash_ranked(rows, "s", ["id"], 1, n).collect()} for n in (10**6, 20))
    assert one == many and sorted(p for p, n in one.values() if n == 78) == list(range(1, 79))


def mixed(seed, c):
    """The counter's number in whole numbers."""
    whole = 2**64
    z = (c * 0x9E3779B97F4A7C15 + seed) % whole
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % whole
    z = (z ^ z >> 27) * 0x94D049BB133111EB % whole
    return ((z ^ z >> 31) >> 11) / 2**53


def test_counted_numbers():
    c = [0, 1, 2, 7, 2**40 + 3, 2**63, 2**64 - 1]
    assert uniform.counted(99, np.array(c, np.uint64)).tolist() == [mixed(99, x) for x in c]
    u = uniform.counted(5, np.arange(100_000))
    n = uniform.counted_normals(5, np.arange(100_000))
    assert abs(u.mean() - 0.5) < 0.005 and abs(n.mean()) < 0.02 and abs(n.std() - 1) < 0.01


def test_bootstrap_draws_places(spark, monkeypatch):
    """Against a loop over all draws, in slices of a few draws and partitions of any number."""
    rows = [(i, [None, "a", "b"][i % 3], int(i % 4 > 0), int(i % 5 > 0)) for i in range(100)]
    d = spark.createDataFrame(rows, "id long, s string, ok_a int, ok_b int")
    differences = []
    strata = [sorted((a, b) for _, t, a, b in rows if t == s) for s in (None, "a", "b")]
    for r in range(30):
        drawn = [c[int(mixed(11, ((k * 30 + r) << 40) + i) * len(c))] for k, c in enumerate(strata) for i in range(len(c))]
        differences.append(sum(a - b for a, b in drawn) / len(rows))
    lower, upper = np.quantile(differences, [0.025, 0.975])
    for draws in (7, 4096):
        monkeypatch.setattr(uncertainty, "DRAWS", draws)
        got = uncertainty.paired_bootstrap(d.repartition(3), "s", 30, 11).first()
        assert got["replicates"] == 30 and abs(got["mean"] - np.mean(differences)) < 1e-12
        assert abs(got["lower"] - lower) < 1e-12 and abs(got["upper"] - upper) < 1e-12
    monkeypatch.setattr(uncertainty, "CELLS", 2)
    with pytest.raises(ValueError, match="different rows"):
        uncertainty.paired_bootstrap(d, "s", 30, 11)


def test_realisations_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), *(rng.normal(size=3) + (i % 3 == 0)).tolist(), 0.1, 0.2, 0.3) for i in range(150)] + [(150, 1, float("inf"), 0.0, 0.0, 0.1, 0.1, 0.1)]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, ea double, eb double, ec double")
    got = {r["realisation"]: r for r in uncertainty.realisation_metrics(d.repartition(4), uncertainty.Measured("id", ["a", "b", "c"], ["ea", "eb", "ec"], "y"), 8, 21, 0.4).collect()}
    target = np.array([r[1] for r in rows])

    def scores(k):
        x = np.array([[m + e * (math.sqrt(-2 * math.log(1 - mixed(21, 2 * c))) * math.cos(2 * math.pi * mixed(21, 2 * c + 1)) if k >= 0 else 0) for j, (m, e) in enumerate(zip(r[2:5], r[5:8])) for c in [(r[0] * 8 + k) * 3 + j]] for r in rows])
        c = x[:, :-1] - x[:, 1:]
        ok = np.isfinite(c).all(axis=1)
        mean, var = [c[ok & (target == t)].mean(axis=0) for t in (0, 1)], c[ok].var(axis=0)
        return np.where(ok, ((c - mean[0]) ** 2 / var).sum(axis=1) - ((c - mean[1]) ** 2 / var).sum(axis=1), np.nan)

    with np.errstate(invalid="ignore"):
        base = scores(-1)
        limit = max(s for s in base[:150] if (target[base >= s] == 1).sum() / (target[:150] == 1).sum() >= 0.4)
        assert sorted(got) == list(range(8))
        for k, r in got.items():
            hit = scores(k) >= limit
            tp, fp = int((hit & (target == 1)).sum()), int((hit & (target == 0)).sum())
            assert (r["n"], r["failed"], r["tp"], r["fp"], r["fn"]) == (151, 1, tp, fp, int((target[:150] == 1).sum()) - tp)
    s = {r["metric"]: r for r in uncertainty.summarize_realisations(spark.createDataFrame([(0, 0.5, None), (1, 0.7, 0.1)], "realisation int, precision double, f1 double"), ("precision", "f1")).collect()}
    assert (s["precision"]["finite"], s["f1"]["failed"], s["f1"]["realisations"]) == (2, 1, 2) and abs(s["precision"]["lower"] - 0.505) < 1e-9


@pytest.mark.parametrize("crowded", [1, 2])
def test_crowded_cells_are_cut_into_blocks(spark, monkeypatch, crowded):
    """One place with most rows of one side or of both: the same pairs, in blocks of about the cap."""
    rng = np.random.default_rng(9)
    few = [(i, 10 + float(rng.normal()) * 1e-5 * (i % 7 > 0), float(rng.normal()) * 1e-5) for i in range(60 if crowded == 2 else 6)]
    many = [(i, 10 + float(rng.normal()) * 1e-5, float(rng.normal()) * 1e-5) for i in range(400)] + [(400 + i, 50.0 + i, 5.0) for i in range(30)]
    a, b = sky(spark, *few), sky(spark, *many)
    plain = sorted(map(tuple, spatial.radius_pairs(a, b, 2.0).select("ref", "target").collect()))
    blocks = spatial.cell_blocks

    def small(placed, copied, p, c):
        one, two, keys = blocks(placed, copied, p, c, crowd=40)
        assert "bn1" in keys
        for t in (one, two):
            assert t.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 80
        return one, two, keys

    monkeypatch.setattr(spatial, "cell_blocks", small)
    got = sorted(map(tuple, spatial.radius_pairs(a, b, 2.0).select("ref", "target").collect()))
    assert got == plain and len(got) > 1000


def test_projections_keep_lengths(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) * [9, 4, 2, 1, 0.5] + 3
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    s = spectrum(d, "x", 5)
    z = np.array([r["components"] for r in project(d, "x", s, 5).orderBy("id").collect()])
    assert np.allclose((z**2).sum(axis=1), ((x - x.mean(axis=0)) ** 2).sum(axis=1)) and np.allclose(z.T @ z, np.diag(s.values**2), atol=1e-8)


def test_audit_of_whole_tables(spark):
    d = spark.createDataFrame([(1, "a", 0.5), (None, "b", -0.0), (3, None, None)], "k int, s string, x double")
    got = {(r["check"], r["column"]): r["value"] for r in audit.audit_tables({"t": d}, ["t"]).collect()}
    assert got == {("rows", ""): "3", ("nulls", "k"): "1", ("nulls", "s"): "1", ("nulls", "x"): "1", ("min", "k"): "1.0", ("max", "k"): "3.0", ("min", "x"): "0.0", ("max", "x"): "0.5"}
    with pytest.raises(ValueError):
        audit.audit_tables({"t": d}, ["u"])


def test_intermediates_lie_in_one_folder_of_the_application(spark):
    t = scratch.written(spark.range(3), "t")
    at = scratch.folder(spark)
    assert at.endswith(spark.sparkContext.applicationId) and all(at.split(":")[-1] in f for f in t.inputFiles())

    class Cluster:
        conf = {}

        class sparkContext:
            master, applicationId = "spark://x:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(Cluster)


def test_forest_folds_side_by_side(spark):
    rows = [(i, [float(i % 3) + (i % 7) / 20, float(i * 37 % 11)], i % 3, i % 4) for i in range(120)]
    d = spark.createDataFrame(rows, "k long, x array<double>, y int, fold int")
    one, many = ({r["k"]: (r["label"], r["fold"], r["probability"]) for r in evaluate.out_of_fold(d, "k", "x", "y", 4, 3, trees=5, depth=3, parallel=n).collect()} for n in (1, 4))
    assert one == many and len(one) == 120
    assert all((label, fold) == (k % 3, k % 4) and abs(sum(p) - 1) < 1e-9 for k, (label, fold, p) in one.items())
    assert sum(max(range(3), key=p.__getitem__) == label for label, _, p in one.values()) > 110


def test_forest_grows_a_few_trees_at_a_time(spark, monkeypatch):
    sizes, forest = [], evaluate.RandomForestClassifier
    monkeypatch.setattr(evaluate, "RandomForestClassifier", lambda **k: sizes.append((k["numTrees"], k["seed"])) or forest(**k))
    rows = [(i // 2, [float(i % 3) + (i % 7) / 20, float(i * 37 % 11)], i % 3 if i else None, i % 2) for i in range(60)]  # a null label, and each key twice
    d = spark.createDataFrame(rows, "k long, x array<double>, y int, fold int")
    got = evaluate.out_of_fold(d, "k", "x", "y", 2, 3, trees=7, depth=3, nodes=48).collect()
    assert sorted(n for n, _ in sizes) == [1, 1, 3, 3, 3, 3] and len({s for _, s in sizes}) == 3
    assert sorted((r["k"], r["label"] is None, r["fold"]) for r in got) == sorted((k, y is None, f) for k, _, y, f in rows)
    assert all(len(r["probability"]) == 3 and abs(sum(r["probability"]) - 1) < 1e-9 for r in got)
    assert sum(max(range(3), key=r["probability"].__getitem__) == r["label"] for r in got) > 50


def test_order_files_follow_the_bytes_not_the_parts(spark, tmp_path, monkeypatch):
    from catalith.plans import catalogue
    spark.range(9000).selectExpr("id * 7 AS o_orderkey", "element_at(array('F', 'O', 'P'), cast(id % 3 + 1 AS int)) AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    numbered = files.numbered_lines
    monkeypatch.setattr(catalogue.files, "numbered_lines", lambda s, path: seen.append(numbered(s, path)) or seen[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files of several blocks
    try:
        got = {(r["status"], r["part"], r["source_row"], r["value"]) for r in catalogue.row_numbers(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, n = set(), {}
    for i in range(9000):
        k = ("FOP"[i % 3], i * 7 // 1000)
        n[k] = n.get(k, 0) + 1
        want.add((*k, n[k], str(i * 7)))
    assert got == want
    assert seen[0].select("source_file").distinct().count() == 3  # 189 parts


@pytest.mark.parametrize("fan", [2, 4, 256])
def test_digest_is_the_trees_root_from_one_shuffle(spark, monkeypatch, fan):
    monkeypatch.setattr(digest, "FAN", fan)  # trees of several levels from few rows
    t = spark.range(300).selectExpr("id % 90 AS a", "cast(id % 45 AS string) AS b").union(spark.range(40).selectExpr("id * 0", "'x'"))
    want = digest.table_tree(t, ["a", "b"]).where("level = 0").select("rows", "sha256").first()
    assert digest.table_digest(t, ["a", "b"]).first() == want
    plan = digest._tops(t, ["a", "b"], 3, 340)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_features_of_a_wide_table_need_no_shuffle(spark):
    rows = [(1, 1.0, 0.1, 99.0, 0.2, 0.5), (2, 3.0, None, 4.0, 0.4, 0.25), (3, 99.0, 0.1, None, 0.2, 0.0)]
    wide = spark.createDataFrame(rows, "k int, a double, a_err double, b double, b_err double, ebv double")
    bands = [measure.Band("a", "a", "a_err", 0.5), measure.Band("b", "b", "b_err", 1.0)]
    got = measure.banded(wide, ["k"], bands, [99.0], "ebv")
    long = measure.unpivot(wide, ["k"], bands, [99.0], "ebv")
    assert sorted(got.collect()) == sorted(features.pivot(long, ["k"], "ab").collect())
    assert sorted(features.wide_in(got, ["k"], "ab", ["a", "a-b"]).collect(), key=str) == sorted(features.wide_view(features.build(long, ["k"], "ab"), ["k"], ["a", "a-b"]).collect(), key=str)
    assert "Exchange" not in features.unpivoted(got, ["k"], "ab")._jdf.queryExecution().executedPlan().toString()


def test_questions_travel_once_to_a_block_of_cells(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(600, 24)))], "id long, x array<double>")
    cells = neighbors.cells_of(p, 10)
    block = cells.blocks(150)
    assert len(cells.centres) == 60 and np.bincount(block, cells.size).max() <= 150
    sent, counts = neighbors._asked(p.withColumn("u", F.lit(1e9)), cells, 150)  # every cell has to be seen
    n = {r["block"]: r["count"] for r in sent.groupBy("block").count().collect()}
    assert n == {int(b): 600 for b in set(block)} == {r["block"]: r["n"] for r in counts.collect()}
    assert len(n) <= 8


def test_nearest_edges_are_the_first_ranked_ones_from_one_row_a_record(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(int(r), int(t), float(s)) for r, t, s in zip(rng.integers(0, 9, 400), rng.integers(0, 40, 400), rng.integers(0, 6, 400), strict=True)], "ref long, target long, sep double").dropDuplicates(["ref", "target"])
    ranked = spatial.reference_ranked(spatial.ranked(pairs))
    got = spatial.nearest(pairs)
    for policy in population.POLICIES:
        first = [sorted(population.apply_policy(e, policy).select("ref", "target", "sep").collect()) for e in (ranked, got)]
        assert first[0] == first[1] and first[0]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranked_edges_of_places_send_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SHARE", 4)  # shares from few rows
    rng = np.random.default_rng(9)
    at = [(0.0, 0.0), (2e-4, 0.0), (-2e-4, 0.0), (0.0, 2e-4), (5e-4, 1e-4), (9.0, 9.0), (None, 1.0)]  # two at one separation from the first
    a, b = (spark.createDataFrame([(int(i), *at[j]) for i, j in zip(rng.permutation(60), rng.integers(0, 7, 60), strict=True)], "id long, ra double, dec double") for _ in "ab")
    want = spatial.reference_ranked(spatial.ranked(spatial.radius_pairs(a, b, 1.5), 6))
    got = spatial.ranked_edges(a, b, 1.5, 6)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and want.count() > 500
    written = []
    monkeypatch.setattr(spatial, "written", lambda d, name: written.append((name, scratch.written(d, name))) or written[-1][1])
    n = spatial.ranked_edges(a, b, 1.5, 6).count()
    assert 5 * max(d.count() for _, d in written) < n


def test_lists_of_a_batch_are_read_once_for_all_realisations(spark):
    from catalith.operators.uncertainty import _colors, _measured
    import pandas as pd
    rows = _measured(pd.DataFrame({"key": [1, 2], "x": [[1.0, 2.0], [3.0, 5.0]], "e": [[0.0, 0.0], [0.0, 0.0]]}))
    assert all((_colors(rows, r, 3, 1) == [[-1.0], [-2.0]]).all() for r in (-1, 0, 2))


@pytest.mark.parametrize("shift", [0.0, 1e3, 1e20])
def test_a_query_is_compared_once_for_all_its_neighbours(spark, shift):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(300, 24))
    x = np.concatenate([x, x[:30], x[:1] + 1e-9 * rng.normal(size=(20, 24))]) * (shift if shift > 1e9 else 1) + (shift if shift < 1e9 else 0)  # copies, and rows that 32 bits do not tell apart
    rows = list(enumerate(x))
    p, half = points(spark, rows), points(spark, [(i, v[:12]) for i, v in rows])
    found = scratch.written(neighbors.knn(half, half, 4, rows=100, cell=30), "found")
    assert found_neighbours(found) == brute_neighbours([(i, v[:12]) for i, v in rows], [(i, v[:12]) for i, v in rows], 4)
    want, m = {}, len(x)
    for q, n in ((r["query"], r["neighbor"]) for r in found.collect()):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want[q, n] = 1 + sum(1 for i in range(m) if i != q and (d[i] < d[n] or (d[i] == d[n] and i < n)))
    got = neighbors.source_ranks(p, found, rows=100, cell=30).collect()
    assert {(r["query"], r["neighbor"]): r["rank"] for r in got} == want
    assert sum(r["compared"] for r in got) <= m * m  # before, for each of the four
    score = 1 - 2 / (m * 4 * (2 * m - 13)) * sum(r - 4 for r in want.values() if r > 4)
    for near in (None, neighbors.knn(p, p, 4)):  # the source's neighbours are not needed
        assert abs(neighbors.trustworthiness(p, near, found, 4).first()["trustworthiness"] - score) < 1e-12


@pytest.mark.parametrize("fan", [4, 256])
def test_digest_in_lots_keeps_one_lot_on_disk(spark, monkeypatch, fan):
    monkeypatch.setattr(digest, "FAN", fan)
    t = spark.range(20_000).selectExpr("id % 19000 AS a", "cast(id % 19000 AS string) AS b")
    want = digest.table_tree(t, ["a", "b"]).where("level = 0").select("rows", "sha256").first()
    monkeypatch.setattr(digest, "LOT", 5_000, raising=False)
    made = []
    monkeypatch.setattr(digest, "written", lambda d, name, **kw: made.append(scratch.written(d, name, **kw)) or made[-1])

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_"))

    before = shuffled()
    assert digest.table_digest(t, ["a", "b"]).first() == want
    assert len(made) == 4 and max(d.agg(F.sum("rows")).first()[0] for d in made) < 5_500
    for _ in range(100):
        if shuffled() - before < 100_000:  # of some 700,000
            break
        time.sleep(0.1)
    assert shuffled() - before < 100_000
    assert spark.conf.get(scratch.CLEANUP) == "false"


def test_millionths_are_rounded_as_decimals(spark):
    from catalith.plans import catalogue
    rng = np.random.default_rng(6)
    half = (rng.integers(-(10**6), 10**6, 400) + 0.5) / 1e6
    x = [*half, *np.nextafter(half, 9), *np.nextafter(half, -9), *(rng.normal(size=400) * 10.0 ** rng.integers(-9, 12, 400)), 0.49999999999999994e-6, -0.49999999999999994e-6, 0.0, -0.0, 4.0e9, 4503599627.370497, 9e12, None]
    d = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double")
    got = d.select(catalogue._millionths("x").alias("a"), F.expr(catalogue._exact("x")).alias("b")).where("not a <=> b")
    assert got.collect() == []
