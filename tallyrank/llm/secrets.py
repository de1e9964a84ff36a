"""Secret scan: fixed patterns, and strings that look random to two Markov models.

Patterns. ``assign`` is a password-like name, ``:`` or ``=`` and a value of 12 and more
characters, ``access`` an access key id of 18 and more, ``hex`` a run of 16 and more
lower-case hexadecimal digits. Matches of a kind are leftmost and do not overlap.

Models. Strings that a pattern matched are samples of random strings, other runs of at least
``WORD`` characters in the same and other texts samples of ordinary identifiers. For either
class a first-order Markov model of characters is counted, the kinds of random strings weighing
the same however often each occurs; a transition's probability is
smoothed by the frequency of the character it leads to. A run of ``RUN`` characters and more
is a secret if its mean log-likelihood ratio exceeds a threshold that is calibrated on
samples training did not see, and if it is not inside what a pattern has found. It is added whole,
also where a pattern has found a part of it.

Scale. Everything is DataFrame functions. The scan has no shuffle: a text's spans are found
in its row, and only texts in which a cheap search succeeds are cut up. Running sums over
the matches of a text go in blocks of blocks, so that its cost hardly grows faster than the text. Samples come
from about ``sample`` texts of each class, drawn by hash; the model is a table of 128 by 128
numbers, passed as a scalar subquery. ``fit`` runs jobs while the plan is built.

Defined cases. Null text is empty, very long ones are scanned whole. Offsets are code points, ends
exclusive. Spans that start together are ordered by kind. Without samples of both classes, an empty
table among these, only the patterns are used. Repeated rows are scanned each. Only id and
text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm.common import bound, drawn, fresh, share_of
from tallyrank.session import write_through

#: Patterns, in the order that spans with equal starts take (fixed values). The runs of hex
#: digits and access keys are greedy, so that a least length finds the long ones just as well.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
#: Shortest identifiers learned from, shortest runs judged.
WORD, RUN = 8, 20
_CHARACTERS = "A-Za-z0-9+/_=-"
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_HELD = "array<struct<start:int,kind:int,end:int,held:string>>"


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column, blocks: int = 2) -> Column:
    """What ``step`` makes of all values up to each, in order.

    An array can grow only by being copied, so blocks of values are gone through one by one, after
    what comes before each block is known from the same over the blocks' totals.
    """
    def grown(part: Column, start: Column) -> Column:
        def add(so_far: Column, value: Column) -> Column:
            now = step(so_far["last"], value)
            return F.struct(now.alias("last"), F.concat(so_far["out"], F.array(now)).alias("out"))

        begin = F.struct(start.alias("last"), F.slice(F.array(start), 1, 0).alias("out"))
        return F.aggregate(part, begin, add, lambda end: end["out"])

    if not blocks:
        return grown(values, zero)

    def blocked(whole: Column) -> Column:
        size = F.ceil(F.pow(F.size(whole), F.lit(1 / (blocks + 1)))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(whole), size), lambda i: F.slice(whole, i, size))

        def chained(parts: Column) -> Column:
            totals = F.transform(parts, lambda part: F.aggregate(part, zero, step))
            before = F.concat(F.array(zero), running(totals, step, zero, blocks - 1))
            return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), grown))

        return F.when(F.size(whole) > 0, bound(cut, chained)).otherwise(F.slice(F.array(zero), 1, 0))

    return bound(values, blocked)


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def _largest(values: Column, least: int) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(least))


def _located(text: Column, pattern: str, kind: int, search: str, value_least: int = 0, matched: bool = False) -> Column:
    """Spans of a pattern as (start, kind, end) and, if wanted, what they hold: what lies between
    matches tells where they are."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        matches, F.split(text, pattern, -1),
        lambda m, gap: F.struct(
            F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), m.alias("held"),
            (F.length(F.regexp_extract(m, pattern, 1)) >= value_least if value_least else m.isNotNull()).alias("kept"),
        ),
    )

    def span(part: Column, end: Column) -> Column:
        held = [part["held"].alias("held")] if matched else []
        found = F.struct((end - part["size"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *held)
        return F.when(part["kept"] & part["held"].isNotNull(), found)

    spans = bound(parts, lambda p: F.array_compact(
        F.zip_with(p, _sums(F.transform(p, lambda x: x["gap"] + x["size"])), span)
    ))
    none = F.array().cast(_HELD if matched else _SPANS)
    return F.when(text.rlike(search), spans).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """Spans of the three patterns."""
    name = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
    return [
        _located(text, ASSIGN, 0, name, VALUE), _located(text, ACCESS, 1, ACCESS), _located(text, HEX, 2, HEX),
    ]


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


# --- models ------------------------------------------------------------------


def _transitions(run: Column) -> Column:
    """Indices of the transitions of a run of ASCII characters."""
    places = F.sequence(F.lit(1), F.length(run) - 1)
    return F.transform(places, lambda i: F.ascii(run.substr(i, F.lit(1))) * 128 + F.ascii(run.substr(i + 1, F.lit(1))))


@dataclass(frozen=True)
class Randomness:
    """Log ratios of all transitions in a one-row table, the threshold of their mean, and the shares
    of random and of ordinary runs held out from training that exceed it."""

    table: DataFrame | None
    threshold: float | None
    recall: float | None = None
    wrong: float | None = None

    def scored(self, df: DataFrame, runs: str, out: str) -> DataFrame:
        """Adds the mean log ratio of each string of an array.

        The model's column is used once, so that the optimizer puts its subquery in that
        place and no row ever holds a copy.
        """
        model = fresh("model")

        def ratio(run: Column) -> Column:
            total = F.aggregate(
                F.transform(_transitions(run), lambda t: F.col(model)[t]), F.lit(0.0), lambda s, x: s + x
            )
            return total / (F.length(run) - 1)

        kept = [c for c in df.columns if c != out]
        return df.withColumn(model, self.table.scalar()).select(*kept, F.transform(runs, ratio).alias(out))


def _model(samples: DataFrame, strength: float) -> DataFrame:
    """The one-row table of log ratios from (kind, run), kind 0 being ordinary."""
    counts = samples.select("kind", F.explode(_transitions(F.col("run"))).alias("t")).groupBy("kind", "t").count()
    of_kind, of_class = Window.partitionBy("kind"), Window.partitionBy(F.col("kind") > 0)
    # random strings of every kind weigh as much as their mean
    kinds = F.size(F.collect_set("kind").over(of_class))
    even = F.col("count") * F.sum("count").over(of_class) / (kinds * F.sum("count").over(of_kind))
    counts = counts.withColumn("n", even).groupBy("t").agg(
        F.sum(F.when(F.col("kind") > 0, F.col("n")).otherwise(0.0)).alias("n1"),
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0.0)).alias("n0"),
    )
    grid = samples.sparkSession.range(128 * 128).select(
        F.col("id").cast("int").alias("t"), F.expr("int(id div 128)").alias("a"), F.expr("int(id % 128)").alias("b")
    ).join(counts, "t", "left").na.fill(0, ["n0", "n1"])
    by_a, by_b, all_ = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(0))

    def log_share(n: str) -> Column:
        to = (F.sum(n).over(by_b) + 1) / (F.sum(n).over(all_) + 128)
        return F.log((F.col(n) + strength * to) / (F.sum(n).over(by_a) + strength))

    return grid.select("t", (log_share("n1") - log_share("n0")).alias("ratio")).agg(
        F.array_sort(F.collect_list(F.struct("t", "ratio"))).alias("cells")
    ).select(F.transform("cells", lambda c: c["ratio"]).alias("ratios"))


def fit(
    df: DataFrame, text: str = "text", *, sample: int = 1_000, strength: float = 8.0, wrong: float = 0.001,
) -> Randomness:
    """Trains the models and calibrates the threshold.

    It lies midway between the score that ``wrong`` of the ordinary runs held out exceed and
    the score that a fiftieth of the random ones stay below; if these overlap, it is the former. It is never below 0.
    """
    rows = df.select(F.col(text).alias("text")).where("text is not null")
    flagged = rows.withColumn("hit", F.col("text").rlike(f"{ACCESS}|{HEX}|{ASSIGN}"))
    total = {r["hit"]: r["count"] for r in flagged.groupBy("hit").count().collect()}
    if not total.get(True):
        return Randomness(None, None)
    share = F.when(F.col("hit"), share_of(total[True], sample)).otherwise(share_of(total.get(False, 0), sample))
    chosen = write_through(flagged.where(drawn(share, "text")), "secret-sample")
    kinds = (
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= VALUE),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )

    def of_kind(kind: int, runs: Column) -> Column:
        return F.transform(runs, lambda run: F.struct(F.lit(kind).alias("kind"), run.alias("run")))

    found = F.concat(*[of_kind(kind, runs) for kind, runs in enumerate(kinds, 1)])
    random = chosen.where("hit").select(F.inline(found)).where(~F.col("run").rlike(rf"[^{_CHARACTERS}]"))
    rest = F.regexp_replace("text", f"{ACCESS}|{HEX}|{ASSIGN}", "\n")
    ordinary = chosen.select(F.explode(F.regexp_extract_all(rest, F.lit(f"[{_CHARACTERS}]{{{WORD},}}"), F.lit(0))).alias("run"))
    samples = random.unionByName(ordinary.select(F.lit(0).alias("kind"), "run")).distinct()
    samples = write_through(samples, "secret-runs")
    held = F.pmod(F.xxhash64(F.lit("held"), "run"), F.lit(4)) == 0
    table = write_through(_model(samples.where(~held), strength), "secret-model")
    model = Randomness(table, None)
    scored = model.scored(samples.where(held).select("kind", F.array("run").alias("runs")), "runs", "score")
    scored = scored.select((F.col("kind") > 0).alias("random"), F.col("score")[0].alias("s"))
    at = {
        r["random"]: r for r in scored.groupBy("random").agg(
            F.percentile_approx("s", 1 - wrong, 10_000).alias("high"),
            F.percentile_approx("s", 0.02, 10_000).alias("low"),
        ).collect()
    }
    if len(at) < 2:
        return Randomness(table, None)
    high, low = at[False]["high"], at[True]["low"]
    threshold = max(0.0, (high + low) / 2 if low > high else high)
    above = {r["random"]: r["share"] for r in scored.groupBy("random").agg(
        F.avg((F.col("s") > threshold).cast("double")).alias("share")
    ).collect()}
    return Randomness(table, threshold, above[True], above[False])


def scan(df: DataFrame, model: Randomness, text: str = "text", *, out: str = "secrets") -> DataFrame:
    """Adds a struct of ``base`` spans and ``all`` spans, in order of start and kind."""
    body, assign, access, hexa, base, runs, scores = map(
        fresh, ("body", "assign", "access", "hex", "base", "runs", "scores")
    )
    kept = [c for c in df.columns if c != out]
    rows = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    found = base_spans(F.col(body))
    rows = rows.withColumns(dict(zip((assign, access, hexa), found)))
    rows = rows.withColumn(base, F.array_sort(F.concat(assign, access, hexa)))
    if model.threshold is None:
        return rows.select(*kept, F.struct(F.col(base).alias("base"), F.col(base).alias("all")).alias(out))
    pattern = f"[{_CHARACTERS}]{{{RUN},}}"
    rows = rows.withColumn(runs, _located(F.col(body), pattern, 3, pattern, matched=True))
    rows = rows.withColumn(runs, F.when(F.size(base) > 0, _not_inside(F.col(runs), F.col(base))).otherwise(F.col(runs)))
    rows = rows.withColumn(scores, F.transform(runs, lambda r: r["held"]))
    rows = model.scored(rows, scores, scores)
    added = F.array_compact(F.zip_with(
        runs, scores, lambda r, s: F.when(s > model.threshold, F.struct(r["start"], r["kind"], r["end"]))
    ))
    every = F.when(F.size(runs) > 0, F.array_sort(F.concat(F.col(base), added))).otherwise(F.col(base))
    return rows.select(*kept, F.struct(F.col(base).alias("base"), every.alias("all")).alias(out))


def _not_inside(runs: Column, base: Column) -> Column:
    """The runs that no base span holds whole: among spans that start no later, the furthest end tells."""
    def mark(s: Column, held: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), held.alias("held"))

    marks = F.array_sort(F.concat(
        F.transform(base, lambda s: mark(s, F.lit(None).cast("string"))), F.transform(runs, lambda s: mark(s, s["held"]))
    ))

    def free(all_marks: Column) -> Column:
        ends = F.transform(all_marks, lambda m: F.when(m["kind"] < 3, m["end"]).otherwise(-1))
        return F.array_compact(F.zip_with(
            all_marks, _largest(ends, -1),
            lambda m, end: F.when((m["kind"] == 3) & (end < m["end"]), m),
        ))

    return bound(marks, free)


#: What a text is cut into, so that a piece of it is found without counting from its beginning.
_PIECE = "(?s).{1,512}"


def masked(df: DataFrame, text: str, spans: Column, sign: str = "<secret>") -> DataFrame:
    """The table with ``sign`` in place of every span of a text; overlapping spans are masked as one.

    Pieces of the text and the borders of spans are put in order together. Between two of these
    marks lies a part of one piece, which goes if a span before it reaches further.
    """
    held, pieces, ends, before, marks, states = map(fresh, ("held", "pieces", "ends", "before", "marks", "states"))

    def mark(at: Column, rank: int, end: Column, piece: int, fresh_span: Column) -> Column:
        # ends of spans come first, then starts, then pieces
        return F.struct(
            at.alias("at"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(piece).alias("piece"),
            fresh_span.alias("fresh"),
        )

    def reach(a: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(a["end"], b["end"]).alias("end"), (a["piece"] + b["piece"]).alias("piece"),
            F.greatest(a["start"], b["start"]).alias("start"),
        )

    def part(m: Column, s: Column) -> Column:
        inside = F.element_at(F.col(pieces), s["state"]["piece"]).substr(
            m["at"] - s["state"]["start"] + 1, s["next"] - m["at"]
        )
        shown = (s["state"]["end"] <= m["at"]) & (s["next"] > m["at"])
        return F.concat(F.when(m["fresh"], F.lit(sign)).otherwise(""), F.when(shown, inside).otherwise(""))

    nothing, no = F.lit(0), F.lit(False)
    rows = df.withColumn(held, spans)
    # texts without spans are not cut up
    rows = rows.withColumn(pieces, F.when(F.size(held) > 0, F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))))
    rows = rows.withColumn(ends, _sums(F.transform(pieces, F.length)))
    reached = _largest(F.transform(held, lambda s: s["end"]), 0)
    rows = rows.withColumn(before, F.slice(F.concat(F.array(nothing), reached), 1, F.size(held)))
    rows = rows.withColumn(marks, F.array_sort(F.concat(
        F.zip_with(held, before, lambda s, end: mark(s["start"], 1, s["end"], 0, s["start"] >= end)),
        F.transform(held, lambda s: mark(s["end"], 0, nothing, 0, no)),
        F.zip_with(pieces, ends, lambda p, end: mark(end - F.length(p), 2, nothing, 1, no)),
    )))
    values = F.transform(marks, lambda m: F.struct(
        m["end"].alias("end"), m["piece"].alias("piece"), (m["at"] * m["piece"]).alias("start")
    ))
    start = F.struct(nothing.alias("end"), nothing.alias("piece"), nothing.alias("start"))
    nexts = F.concat(F.slice(F.transform(marks, lambda m: m["at"]), 2, F.size(marks)), F.array(F.length(text)))
    rows = rows.withColumn(states, F.arrays_zip(running(values, reach, start).alias("state"), nexts.alias("next")))
    whole = F.array_join(F.zip_with(marks, states, part), "")
    return rows.withColumn(text, F.when(F.size(held) > 0, whole).otherwise(F.col(text))).select(*df.columns)
