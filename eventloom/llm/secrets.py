"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression, from which a Boolean trigram query is derived (see ``trigrams``). The index holds
postings (trigram, text) for the trigrams that some query names, and is written; a text is known by 128 bits of hash, so
copies have one posting. The postings of each clause's trigrams are intersected: a text that all of them hold is a
candidate for the clause's rule, and only candidates are verified with the rule's expression. A rule without a mandatory
trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams
from .common import Written, text_key


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must reach ``least``. What ``pattern`` repeats is a class of characters, as the
    JVM takes stack for each repeat of a group."""

    kind: str
    pattern: str
    least: int
    value: int = 0


#: The base rules in the order of spans, then the rules that add spans. The run of hexadecimal digits is
#: written with its least length: runs are maximal either way, and shorter ones are dropped by their length anyway.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 24),
    Rule("pem", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----", 20),
)
BASE = ("assign", "access", "hex")


class Plan:
    """The rules' queries: ``clauses`` of (rule's number, trigrams), and the numbers of the rules that scan everything."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        queries = [trigrams.query(r.pattern) for r in rules]
        self.full = [i for i, q in enumerate(queries) if q == trigrams.ALL]
        self.clauses = [(i, sorted(c)) for i, q in enumerate(queries) if q != trigrams.ALL for c in sorted(q, key=sorted)]
        self.names = sorted({t for _, c in self.clauses for t in c})

    def table(self, spark: SparkSession) -> DataFrame:
        """(trigram, clause, rule, size): a row for each trigram of each clause, bounded by the rules."""
        rows = [F.struct(F.lit(t).alias("trigram"), F.lit(n).alias("clause"), F.lit(rule).alias("rule"), F.lit(len(c)).alias("size")) for n, (rule, c) in enumerate(self.clauses) for t in c]
        return spark.range(1).select(F.inline(F.array(*rows)))


def postings(texts: DataFrame, plan: Plan) -> DataFrame:
    """(trigram, _k1, _k2): which texts (``_k1``, ``_k2``, ``_text``) contain which of the plan's trigrams in any case."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(trigrams.finder(plan.names)), F.lit(1)))
    return texts.select("_k1", "_k2", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, plan: Plan) -> DataFrame:
    """(_k1, _k2, _rules): the texts that all posting lists of some clause hold, with their rules' numbers."""
    met = index.join(F.broadcast(plan.table(index.sparkSession)), "trigram").groupBy("_k1", "_k2", "clause", "rule", "size").agg(F.count("*").alias("n")).where("n = size")
    return met.groupBy("_k1", "_k2").agg(F.collect_set("rule").alias("_rules"))


SPAN = "array<struct<start:int,kind:int,stop:int>>"


def spans_of(rule: Rule, number: int, text: Column) -> Column:
    """Leftmost non-overlapping matches whose value is long enough: (start, kind, stop) in code points.

    The text between matches comes from a split by the same pattern; running lengths give the offsets.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value)) if rule.value else matches
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(between, F.zip_with(matches, values, lambda m, v: F.struct(F.char_length(m).alias("m"), F.char_length(v).alias("v"))), lambda gap, mv: F.struct(F.char_length(gap).alias("gap"), mv.alias("mv")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.coalesce(x["mv"]["m"], F.lit(0))
        span = F.array(F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("stop"))).cast(SPAN)
        return F.struct(b.alias("at"), F.when(x["mv"]["v"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(lengths, start, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(SPAN))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", keep: dict[str, str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns that ``keep`` names and ``found``: all spans as structs (start, kind's number, stop), sorted.

    Null texts count as empty, and have no spans. Texts of any length are searched whole. Equal spans of two rules both
    stay; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    keep, plan, none = keep or {"doc_id": "doc_id"}, Plan(rules), F.array().cast(SPAN)
    body = F.coalesce(F.col("_text"), F.lit(""))
    held = df.select(*[F.col(a).alias(f"_keep{i}") for i, a in enumerate(keep)], F.col(text).cast("string").alias("_text")).select("*", *text_key(F.col("_text")))
    found = [spans_of(rules[i], i, body) for i in plan.full]
    if plan.clauses:
        index = Written(postings(held.select("_k1", "_k2", "_text"), plan), "secret-postings")
        # Written, so that the join of all rows is a join alone: a small table is broadcast, else hot keys may be split.
        asked = Written(candidates(index.df, plan), "secret-candidates").df
        index.drop()
        held = held.join(asked, ["_k1", "_k2"], "left")
        found += [F.when(F.array_contains("_rules", i), spans_of(rules[i], i, body)).otherwise(none) for i in sorted({i for i, _ in plan.clauses})]
    return held.select(*[F.col(f"_keep{i}").alias(b) for i, b in enumerate(keep.values())], F.array_sort(F.concat(none, *found)).alias("found"))


def report(df: DataFrame, text: str = "text", keep: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep``, counts of the base kinds, ``base_sha256`` and ``spans`` of each row.

    Nulls, empty and long texts, repeated rows, empty tables and other columns as in ``scan``; a null ``keep`` stays null.
    """
    found = scan(df, text, {keep: keep}, rules)
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(keep, *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(_joined(base, rules).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found"), rules).alias("spans"))


def mask_spans(text: Column, found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first
    gives the kind, and all that any of them covers goes."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(F.get(names, s["kind"])), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), put.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(text.isNull() | (F.size(found) == 0), text).otherwise(done)
