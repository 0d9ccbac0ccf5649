"""Golden values of the fixtures, and the corners: empty names, bounds, signed zeros, codecs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.functions.kinds import duration, error_kind, nines_label, shortest, with_viewbox
from spanloom.functions.slots import MAX_INT, float_lower, float_slot, int_slot, lower, upper
from spanloom.operators import hist as H, stats as S
from spanloom.sinks import export as X
from spanloom.sources.spans import Timers, spans


def ints(spark, values):
    return H.build_int(spark.createDataFrame([("a", v) for v in values], "name string, v bigint"), "v", ["name"])


def floats(spark, values):
    return H.build_float(spark.createDataFrame([("a", float(v)) for v in values], "name string, v float"), "v", ["name"])


def names(spark):
    return spark.createDataFrame([("a",)], "name string")


def test_int_ramp(spark):
    h = ints(spark, range(1000)).cache()
    assert h.count() == 259
    assert {r.q: r.value for r in S.quantiles(h, ["name"], [0, 0.25, 0.5, 1]).collect()} == {0: 0, 0.25: 250, 0.5: 500, 1: 1000}
    assert {r.v: r.p for r in S.cdf(h, ["name"], [-1, 0, 250, 500, 1000]).collect()} == {-1: 1.0, 0: 0.001, 250: 0.252, 500: 0.504, 1000: 1.0}
    m = S.moments(h, ["name"]).first()
    assert (m["total"], m["sum"], m["average"]) == (1000, 499532.0, 499.532)
    assert m["variance"] == pytest.approx(83361.358976)
    blob = codec.serialize(h).first()["data"]
    assert len(blob) == 301


def test_int_bounds_and_empty(spark):
    for values, n in (([0], 1), ([0, -1], 1), ([0, MAX_INT], 2), ([0, MAX_INT, MAX_INT + 1, 2**63 - 1, None], 2)):
        assert S.total(ints(spark, values), ["name"]).first()["total"] == n
    none = ints(spark, [-1])
    assert S.moments(none, ["name"], names(spark)).first()[1:] == (0, 0.0, 0.0, 0.0)
    assert S.quantiles(none, ["name"], [0.5], names(spark)).first()["value"] == MAX_INT
    assert math.isnan(S.cdf(none, ["name"], [5], names(spark)).first()["p"])
    assert [r["value"] for r in S.quantiles(ints(spark, [1000]), ["name"], [0, 0.5, 1]).orderBy("q").collect()] == [968, 1000, 1000]


def test_every_int_slot_is_next_to_the_last(spark):
    s = spark.range(57 * 64).select((F.col("id") / 64).cast("int").alias("b"), (F.col("id") % 64).cast("int").alias("e"), "id")
    s = s.select("id", "b", "e", lower(F.col("b"), F.col("e")).alias("lo"), upper(F.col("b"), F.col("e")).alias("hi"))
    back = s.select("*", *(x.alias(n) for c in ("lo", "hi") for x, n in zip(int_slot(F.col(c)), (f"{c}b", f"{c}e"), strict=True))).orderBy("id").collect()
    assert all((r.lob, r.loe, r.hib, r.hie) == (r.b, r.e, r.b, r.e) for r in back)
    assert all(a.hi + 1 == b.lo for a, b in zip(back, back[1:], strict=False))
    assert back[0].lo == 0 and back[-1].hi == MAX_INT


def test_float_ramp(spark):
    h = floats(spark, range(1000)).cache()
    assert h.count() == 317
    assert {r.q: r.value for r in S.quantiles(h, ["name"], [0, 0.25, 0.5, 1]).collect()} == {0: 0, 0.25: 248, 0.5: 496, 1: 992}
    assert {r.v: r.p for r in S.cdf(h, ["name"], [0, 250, 500, 1000]).collect()} == {0: 0.001, 250: 0.252, 500: 0.504, 1000: 1.0}
    m = S.moments(h, ["name"]).first()
    assert (m["sum"], m["average"]) == (499978.6640625, 499.9786640625)
    assert m["variance"] == pytest.approx(83433.942757616)


def test_float_corners(spark):
    one = floats(spark, [999])
    assert [r["value"] for r in S.quantiles(one, ["name"], [0, 1]).orderBy("q").collect()] == [768, 992]
    assert S.moments(one, ["name"]).first()["variance"] == 0
    two = floats(spark, [999, 1000])
    assert math.isnan(S.moments(two, ["name"], strict_parity=True).first()["variance"])
    assert S.moments(two, ["name"]).first()["variance"] >= 0
    assert floats(spark, [math.nan, math.inf, -math.inf]).count() == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v float").select(float_slot(F.col("v")).alias("s")).collect()
    assert [r.s for r in zeros] == [16384, 16383]
    assert math.isnan(S.quantiles(floats(spark, []), ["name"], [0.5], names(spark)).first()["value"])


def test_float_slots_are_the_bits(spark):
    import struct

    r = random.Random(1)
    values = [struct.unpack("<f", struct.pack("<I", r.getrandbits(32)))[0] for _ in range(4000)] + [2.0**k for k in range(-149, 128)] + [-(2.0**k) for k in range(-149, 128)]
    values = [v for v in values if math.isfinite(v)]

    def slot(v):
        u = struct.unpack("<I", struct.pack("<f", v))[0]
        return (u ^ 0xFFFFFFFF if u >> 31 else u | 1 << 31) >> 17

    got = spark.createDataFrame([(v,) for v in values], "v float").select("v", float_slot(F.col("v")).alias("s"), float_lower(float_slot(F.col("v"))).alias("lo")).collect()
    assert all(x.s == slot(x.v) for x in got)
    assert all(x.lo <= x.v for x in got)


@pytest.mark.parametrize(
    "counts, data",
    [({}, "01000000000000000139"), ({0: 1}, "020000000000000004fd38"), ({i: 1 for i in range(10)}, "000400000000000004000000000000000000d938"), ({1: 2, 3: 1, 258: 1}, "550000000000000002080202f90300f534")],
)
def test_int_bytes(counts, data):
    assert codec.encode_int(counts).hex() == data
    assert codec.decode_int(bytes.fromhex(data)) == counts


def test_float_bytes():
    assert codec.encode_float({}).hex() == "00000000"
    assert codec.encode_float({16384: 1}).hex() == "00000100010000000100000002"


def test_codecs_return_what_they_took_and_name_their_errors(spark):
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randrange(3648): r.choice([1, 2, 5, r.getrandbits(31) + 1, 2**32 - 1]) for _ in range(r.randrange(400))}
        assert codec.decode_int(codec.encode_int(counts)) == counts
        wide = {r.randrange(32768): r.getrandbits(r.randrange(1, 64)) + 1 for _ in range(r.randrange(400))}
        assert codec.decode_float(codec.encode_float(wide)) == wide
    with pytest.raises(codec.CodecError):
        codec.encode_int({0: 1 << 32})
    for bad in (b"", b"\0" * 9, codec.encode_int({5: 7})[:-1], codec.encode_int({}) + b"\0"):
        with pytest.raises(codec.CodecError):
            codec.decode_int(bad)
    assert codec.decode_float(codec.encode_float({7: 9}) + b"rest") == {7: 9}
    blobs = spark.createDataFrame([("x", b"junk"), ("y", codec.encode_int({3: 4}))], "name string, data binary")
    assert sorted((x.name, x.n, x.error is not None) for x in codec.load(blobs).collect()) == [("x", None, True), ("y", 4, False)]


def test_varints():
    for k in range(33):
        assert codec.take(codec.put(2**k - 1, 5) + b"\xff" * 8, 0, 5)[0] == 2**k - 1
    for k in range(65):
        assert codec.take(codec.put(2**k - 1, 8) + b"\xff" * 8, 0, 8)[0] == 2**k - 1


def test_error_kinds(spark):
    cases = [("some error: whatever", "some error"), (":x y", "error"), (":x", ":x"), ("problem", "problem"), ("a b", "error"), ("", ""), (None, "")]
    df = spark.createDataFrame([(m,) for m, _ in cases], "m string")
    assert [r.k for r in df.select(error_kind(F.lit(None).cast("string"), F.col("m")).alias("k")).collect()] == [k for _, k in cases]
    assert df.limit(1).select(error_kind(F.lit("named"), F.col("m")).alias("k")).first().k == "named"


def test_ladder(spark):
    totals = spark.createDataFrame([("5", 5), ("6", 6), ("50", 50), ("51", 51), ("0", 0)], "name string, total bigint")
    got = {}
    for r in X.ladder(totals).collect():
        got.setdefault(r.name, []).append(r.q)
    assert {k: sorted(v) for k, v in got.items()} == {"0": [0, 0.5, 1], "5": [0, 0.5, 1], "6": [0, 0.5, 0.9, 1], "50": [0, 0.5, 0.9, 1], "51": [0, 0.5, 0.9, 0.99, 1]}


def test_formats(spark):
    times = [(0, "0s"), (7, "7ns"), (1500, "1.5µs"), (1_500_000, "1.5ms"), (1_000_000_000, "1s"), (90_500_000_000, "1m30.5s"), (3_600_000_000_000, "1h0m0s"), (-1500, "-1.5µs"), (2**63 - 1, "2562047h47m16.854775807s")]
    assert [r.d for r in spark.createDataFrame([(n,) for n, _ in times], "n bigint").select(duration(F.col("n")).alias("d")).collect()] == [t for _, t in times]
    numbers = [(0.0, "0"), (0.5, "0.5"), (1e6, "1e+06"), (123456.0, "123456"), (1234567.0, "1.234567e+06"), (0.0001, "0.0001"), (0.00001, "1e-05"), (-2.5, "-2.5"), (0.1 + 0.2, "0.30000000000000004"), (9223372036.854776, "9.223372036854776e+09"), (float("nan"), "NaN"), (float("inf"), "+Inf")]
    assert [r.t for r in spark.createDataFrame([(x,) for x, _ in numbers], "x double").select(shortest(F.col("x")).alias("t")).collect()] == [t for _, t in numbers]
    boxes = spark.createDataFrame([("<svg>x",), ("none",)], "s string").select(with_viewbox(F.col("s"), 10, 20).alias("b")).collect()
    assert [r.b for r in boxes] == ['<svg viewBox="-0.5 -0.5 10 20">x', "none"]
    assert [r.l for r in spark.range(5).select(nines_label(F.col("id").cast("int")).alias("l")).collect()] == ["0%", "90%", "99%", "99.9%", "99.99%"]


def test_shortest_is_read_back(spark):
    r = random.Random(3)
    values = [s * float(f"1e{k}") for k in range(-323, 309) for s in (1, -1)] + [2.0**k for k in range(-1074, 1024)] + [r.uniform(0, 1) * 10.0 ** r.randint(-300, 300) for _ in range(2000)]
    got = {x.v: x.t for x in spark.createDataFrame([(v,) for v in values], "v double").select("v", shortest(F.col("v")).alias("t")).collect()}
    assert all(float(t) == v for v, t in got.items())
    assert [got[v] for v in (1e22, 1e23, 1e154, -1e-5, 1e-300)] == ["1e+22", "1e+23", "1e+154", "-1e-05", "1e-300"]


def test_formats_are_made_once_for_each_row(spark):
    from spanloom.plans.catalogue import QUERIES

    plan = QUERIES["text_formats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    assert 1 <= code.count("new java.util.Formatter(") <= 2  # 17 digits, and the exponent where there is one


def test_timers_and_pages(spark):
    t = Timers()
    for name in ("foo", "foo", "bar"):
        with t.start(name):
            pass
    with pytest.raises(ValueError), t.start("bad"):
        raise ValueError("some error: x")

    @t.timed
    def work():
        return 7

    assert work() == 7
    s = spans(t.frame(spark)).cache()
    assert {r.name: r["count"] for r in s.groupBy("name").count().collect()}["foo"] == 2
    assert s.where("kind <> ''").first().kind == "some error"
    assert spans(t.frame(spark), enabled=False).count() == 0
    h = H.build_int(s, "duration_ns", ["name"])
    page = X.index_page(X.index(h, s.select("name").union(spark.createDataFrame([("<b>",)], "name string"))))
    assert "&lt;b&gt;" in page and "<b>" not in page
    assert X.detail_page(h, "foo", "x", "100", "50").startswith("<svg viewBox") or "viewBox" in X.detail_page(h, "foo")
    assert X.detail_page(h, "nobody") is None


def test_null_names_keep_their_observations(spark):
    from spanloom.operators import registry as R

    s = spark.createDataFrame([(None, 5, "e"), ("a", 7, "")], "name string, duration_ns bigint, kind string")
    every = spark.createDataFrame([(None,), ("b",)], "name string")
    assert sorted(map(tuple, R.snapshot(s, every).collect()), key=str) == [("a", 1, 0), ("b", 0, 0), (None, 1, 1)]
    h = H.build_int(s, "duration_ns", ["name"])
    assert {r["name"]: r.total for r in S.total(h, ["name"], every).collect()} == {None: 1, "b": 0}
    assert {r["name"]: r.value for r in S.quantiles(h, ["name"], [1.0], every).collect()} == {None: 5, "b": MAX_INT}
    assert {r["name"]: r.p for r in S.cdf(h, ["name"], [9], every).where("not isnan(p)").collect()} == {None: 1.0}


def test_drains_are_disjoint(spark, tmp_path):
    from spanloom.streaming import windows as T

    for k in range(3):
        spark.createDataFrame([("a", v) for v in range(k, 40)], "name string, v bigint").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("name string, v bigint").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = T.drained(stream, "v", ["name"], str(tmp_path / "state"))
    assert sorted(r.n for r in found.groupBy("batch").agg(F.sum("n").alias("n")).collect()) == [38, 39, 40]
    assert T.drained(stream, "v", ["name"], str(tmp_path / "state")).count() == 0  # the second drain is empty
    got = []
    T.drain(stream, "v", ["name"], lambda df, n: got.append(df.agg(F.sum("n")).first()[0]), str(tmp_path / "other")).processAllAvailable()
    assert sorted(got) == [38, 39, 40]


def test_merge_is_adding(spark):
    a, b = ints(spark, range(500)), ints(spark, range(400, 1000))
    both = {(r.bucket, r.entry): r.n for r in H.merge(a, b).collect()}
    assert both == {(r.bucket, r.entry): r.n for r in ints(spark, [*range(500), *range(400, 1000)]).collect()}
    assert H.from_arrays(H.to_arrays(a, ["name"]), ["name"]).exceptAll(a).count() == 0
