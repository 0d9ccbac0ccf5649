"""Exports of int histograms by name: line protocol, Prometheus samples, HTML index, percentile charts.

Each takes hist (name, bucket, entry, n), errors (name, kind, n) and names (name): every name is exported, also without
observations. All but the pages are DataFrames, to be written with write.text or a foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.kinds import duration, escaped, label_value, nines, nines_label, quoted, seconds, shortest, with_viewbox
from ..operators.stats import moments, percentiles, quantiles

#: The percentile ladder's steps: 0.9, 0.99, ... as far as totals go.
STEPS = [float("0." + "9" * k) for k in range(1, 18)]


def ladder(totals: DataFrame) -> DataFrame:
    """(name, q): 0, 0.5, a nine more for each power of ten whose half is below the total, and 1."""
    steps = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(10**k // 2).cast("long").alias("least")) for k, q in enumerate(STEPS, 1)))
    held = F.transform(F.filter(steps, lambda s: s["least"] < F.col("total")), lambda s: s["q"])
    return totals.select("name", F.explode(F.concat(F.array(F.lit(0.0), F.lit(0.5)), held, F.array(F.lit(1.0)))).alias("q"))


def line_points(hist: DataFrame, errors: DataFrame, names: DataFrame, histograms: bool = True) -> DataFrame:
    """(name, part, kind, q, value): part 0 total, 1 error count, 2 average and 3 percentile, in seconds."""
    stats = moments(hist, ["name"], names)
    no_kind, no_q = F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("q")
    both = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("total").cast("double").alias("value")), F.struct(F.lit(2).alias("part"), seconds(F.col("average")).alias("value")))).alias("x")
    out = stats.select("name", both).select("name", "x.part", no_kind, no_q, "x.value")
    out = out.unionByName(errors.select("name", F.lit(1).alias("part"), "kind", no_q, F.col("n").cast("double").alias("value")))
    if histograms:
        wanted = ladder(stats)
        found = quantiles(hist, ["name"], list(dict.fromkeys([0.0, 0.5, *STEPS, 1.0])), names)
        at = wanted.join(found, ["name", "q"])
        out = out.unionByName(at.select("name", F.lit(3).alias("part"), no_kind, "q", seconds(F.col("value").cast("double")).alias("value")))
    return out


def lines(points: DataFrame, measurement: str = "") -> DataFrame:
    """(value): the line protocol, in order of name, part, kind and q."""
    head = F.concat(quoted(F.lit(measurement)), F.lit(",name="), quoted(F.col("name"))) if measurement else quoted(F.col("name"))
    value = shortest(F.col("value"))
    body = (
        F.when(F.col("part") == 0, F.concat(F.lit(" total="), F.col("value").cast("long").cast("string"), F.lit("i")))
        .when(F.col("part") == 1, F.concat(F.lit(",error="), quoted(F.col("kind")), F.lit(" count="), F.col("value").cast("long").cast("string"), F.lit("i")))
        .when(F.col("part") == 2, F.concat(F.lit(" average="), value))
        .otherwise(F.concat(F.lit(",percentile="), shortest(F.col("q")), F.lit(" value="), value))
    )
    return points.orderBy("name", "part", "kind", "q").select(F.concat(head, body).alias("value"))


# Fixed values: (family, type, labels, help) of the metrics.
FAMILIES = (
    ("mon_total", "counter", "name", "Total executed"),
    ("mon_errors", "counter", "name,error", "Count of errors"),
    ("mon_average", "gauge", "name", "Average of monitored time"),
    ("mon_histogram", "histogram", "name", "Histogram of monitored times (milliseconds)"),
)


def describe(spark, histograms: bool = True) -> DataFrame:
    return spark.createDataFrame([f for f in FAMILIES if histograms or f[0] != "mon_histogram"], "family string, type string, labels string, help string")


def samples(hist: DataFrame, errors: DataFrame, names: DataFrame) -> DataFrame:
    """(family, name, error, value): totals, errors and averages."""
    stats = moments(hist, ["name"], names)
    none = F.lit(None).cast("string").alias("error")
    both = F.explode(F.array(F.struct(F.lit("mon_total").alias("family"), F.col("total").cast("double").alias("value")), F.struct(F.lit("mon_average").alias("family"), seconds(F.col("average")).alias("value")))).alias("x")
    out = stats.select("name", both).select("x.family", "name", none, "x.value")
    return out.unionByName(errors.select(F.lit("mon_errors").alias("family"), "name", F.col("kind").alias("error"), F.col("n").cast("double").alias("value")))


def histogram_samples(hist: DataFrame) -> DataFrame:
    """(name, le, count, sample_count, sample_sum): cumulative buckets. The sum takes each observation at its slot's upper end, so it is at least the sum of the middles."""
    walk = percentiles(hist, ["name"])
    before = F.lag("count", 1, 0).over(W.partitionBy("name").orderBy("count"))
    parts = walk.withColumn("part", (F.col("count") - before) * F.col("value").cast("double"))
    return parts.withColumn("sample_sum", F.sum("part").over(W.partitionBy("name"))).select("name", F.col("value").alias("le"), "count", F.col("total").alias("sample_count"), "sample_sum")


def exposition(simple: DataFrame, buckets: DataFrame) -> DataFrame:
    """(value): Prometheus' text format, in order of family, name and value. Each family that has samples begins with its HELP and TYPE; a histogram ends with its +Inf bucket, sum and count, also one of no observations."""
    spark = simple.sparkSession
    own = F.concat(F.lit("{name="), label_value(F.col("name")))
    place = (F.col("family"), F.lit(1).alias("part"), "name")
    label = F.concat(own, F.when(F.col("error").isNotNull(), F.concat(F.lit(",error="), label_value(F.col("error")))).otherwise(F.lit("")), F.lit("} "))
    out = simple.select(*place, F.lit(0.0).alias("at"), F.coalesce("error", F.lit("")).alias("k"), F.concat(F.col("family"), label, shortest(F.col("value"))).alias("value"))

    def bucket(le: str, count: str):
        return F.concat(F.lit("mon_histogram_bucket"), own, F.lit(',le="'), shortest(F.col(le)), F.lit('"} '), F.col(count).cast("string"))

    held = buckets.withColumn("family", F.lit("mon_histogram")).withColumn("le", F.col("le").cast("double"))
    out = out.unionByName(held.select(*place, F.col("le").alias("at"), F.lit("a").alias("k"), bucket("le", "count").alias("value")))
    ends = held.groupBy("name").agg(F.first("sample_count").alias("n"), F.first("sample_sum").alias("s"))
    ends = ends.unionByName(simple.where("family = 'mon_total' and value = 0").select("name", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")))
    ends = ends.withColumn("family", F.lit("mon_histogram")).withColumn("le", F.lit(float("inf")))
    last = F.array(F.struct(F.lit("b").alias("k"), bucket("le", "n").alias("value")), F.struct(F.lit("c").alias("k"), F.concat(F.lit("mon_histogram_sum"), own, F.lit("} "), shortest(F.col("s"))).alias("value")), F.struct(F.lit("d").alias("k"), F.concat(F.lit("mon_histogram_count"), own, F.lit("} "), F.col("n").cast("string")).alias("value")))
    out = out.unionByName(ends.select(*place, F.col("le").alias("at"), F.explode(last).alias("x")).select("family", "part", "name", "at", "x.k", "x.value"))
    about = spark.createDataFrame([(f, 0, "", 0.0, str(i), f"# {word} {f} {text}") for f, kind, _, help in FAMILIES for i, (word, text) in enumerate((("HELP", help), ("TYPE", kind)))], "family string, part int, name string, at double, k string, value string")
    return out.unionByName(about.join(out.select("family").distinct(), "family", "left_semi")).orderBy("family", "part", "name", "at", "k").select("value")


def index(hist: DataFrame, names: DataFrame) -> DataFrame:
    """(name, total, sum, average, variance, stddev) of every name."""
    return moments(hist, ["name"], names).withColumn("stddev", F.sqrt("variance"))


def index_lines(rows: DataFrame) -> DataFrame:
    """(part, name, value): the index as lines of HTML, a row for each name with a link to its chart; in order of part and name."""
    spark = rows.sparkSession
    cells = F.concat(*(F.concat(F.lit("<td>"), duration(F.col(c)), F.lit("</td>")) for c in ("sum", "average", "variance", "stddev")))
    line = F.concat(F.lit('<tr><td><a href="'), escaped(F.col("name")), F.lit('">'), escaped(F.col("name")), F.lit("</a></td><td>"), F.col("total").cast("string"), F.lit("</td>"), cells, F.lit("</tr>"))
    ends = [(0, "", "<table><tr><th>name</th><th>total</th><th>sum</th><th>average</th><th>variance</th><th>stddev</th></tr>"), (2, "", "</table>")]
    return rows.select(F.lit(1).alias("part"), "name", line.alias("value")).unionByName(spark.createDataFrame(ends, "part int, name string, value string"))


def index_page(rows: DataFrame) -> str:
    """The index as one text."""
    return "\n".join(r.value for r in index_lines(rows).orderBy("part", "name").toLocalIterator())


def axis(hist: DataFrame, power: int = -1) -> DataFrame:
    """(power): one row, how many nines the axis of a chart of all names in hist has: power, or if that isn't above 0, the digits of the total of the last name."""
    if power > 0:
        return hist.sparkSession.createDataFrame([(power,)], "power int")
    totals = hist.groupBy("name").agg(F.sum("n").alias("total"))
    return totals.agg(F.length(F.max_by("total", "name").cast("string")).alias("power")).where("power is not null")


def chart_points(hist: DataFrame, power: int = -1) -> DataFrame:
    """(name, x, y): the percentile walk of each name on a shared axis of nines. With power > 0 the walk stops at 1 - 0.1^power; else at 1, which is the end of the axis."""
    walk = percentiles(hist, ["name"]).withColumn("p", F.col("count") / F.col("total"))
    largest = 1.0 - 0.1**power if power > 0 else 1.0
    walk = walk.where(F.col("p") <= largest).join(F.broadcast(axis(hist, power)))  # one row
    return walk.select("name", nines(F.col("p"), F.col("power")).alias("x"), F.col("value").cast("double").alias("y"))


def chart_ticks(spark: SparkSession, power: int) -> DataFrame:
    """(x, label): the axis' nines up to power, and 50% and 75%."""
    return _ticks(spark.createDataFrame([(power,)], "power int"))


def _ticks(axis: DataFrame) -> DataFrame:
    main = axis.select(F.explode(F.sequence(F.lit(0), F.col("power"))).alias("i")).select(F.col("i").cast("double").alias("x"), nines_label(F.col("i")).alias("label"))
    return main.unionByName(axis.select(F.explode(F.array(F.struct(F.log10(F.lit(2.0)).alias("x"), F.lit("50%").alias("label")), F.struct(F.log10(F.lit(4.0)).alias("x"), F.lit("75%").alias("label")))).alias("t")).select("t.*"))


#: The colours of a chart's lines, in turn.
COLOURS = ("steelblue", "seagreen", "firebrick", "darkorange", "purple", "teal")


def chart_lines(hist: DataFrame, power: int = -1, width: int = 1300, height: int = 300) -> DataFrame:
    """(part, at, value): an SVG of the percentile walks of all names in hist, as lines in order of part and at; none without observations.

    Its axes are nines, with a tick and a grid line at 50% and 75% too, and durations, at the right. Each name is a line in a colour of its own.
    """
    spark = hist.sparkSession
    points = chart_points(hist, power).join(F.broadcast(axis(hist, power)))
    high = points.agg(F.greatest(F.max("y"), F.lit(1.0)).alias("high"), F.max("power").alias("power")).where("power is not null")
    px = lambda x, far, size: F.floor(x / far * size + F.lit(0.5)).cast("string")
    part = lambda n, at, *text: (F.lit(n).alias("part"), at.alias("at"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in text)).alias("value"))
    none = F.lit(0).cast("double")
    head = high.select(F.lit(0).alias("part"), none.alias("at"), with_viewbox(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'), width, height).alias("value"))
    ticks = _ticks(high.select("power")).join(F.broadcast(high))
    x = px(F.col("x"), F.col("power"), width)
    grid = ticks.where("x > 0").select(*part(1, F.col("x"), '<line stroke="black" stroke-width="1" y1="0" x1="', x, '" x2="', x, f'" y2="{height}"/>'))
    labels = ticks.select(*part(2, F.col("x"), '<text x="', x, f'" y="{height}">', F.col("label"), "</text>"))
    sides = high.select("high", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("k"))
    sides = sides.select(*part(3, F.col("k").cast("double"), f'<text text-anchor="end" x="{width}" y="', (F.lit(height) - F.floor(F.col("k") * height / 4 + F.lit(0.5))).cast("string"), '">', duration(F.col("high") * F.col("k") / 4), "</text>"))
    at = F.concat(px(F.col("x"), F.col("power"), width), F.lit(","), (F.lit(height) - px(F.col("y"), F.col("high"), height)).cast("long").cast("string"))
    dots = points.join(F.broadcast(high.select("high"))).groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", at.alias("at")))), lambda p: p["at"]), " ").alias("points"))  # a name has 3,649 at most
    dots = dots.withColumn("k", F.row_number().over(W.orderBy("name")))
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("k") - 1) % len(COLOURS) + 1)
    drawn = dots.select(*part(4, F.col("k").cast("double"), '<polyline fill="none" stroke-width="3" stroke="', colour, '" points="', F.col("points"), '"><title>', escaped(F.col("name")), "</title></polyline>"))
    out = head
    for more in (grid, labels, sides, drawn, high.select(*part(5, none, "</svg>"))):
        out = out.unionByName(more)
    return out


def detail_page(hist: DataFrame, name: str, power: str = "-1", width: str = "1300", height: str = "300") -> str | None:
    """The chart of a name; None if there is no such name. Parameters that are no numbers count as their defaults."""

    def number(text: str, default: int) -> int:
        try:
            return int(text)
        except ValueError:
            return default

    own = hist.where(F.col("name") == name)
    found = chart_lines(own, number(power, -1), number(width, 1300), number(height, 300)).orderBy("part", "at").collect()  # a line for each tick, and one for the name
    return "\n".join(r.value for r in found) if found else None
