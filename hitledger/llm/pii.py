"""Personal data: fixed forms, and identifiers that contexts learned from them discover. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import common as C
from .spans import SPANS, by_place

KINDS = ("email", "ip", "card", "phone")
NAME = "[A-Za-z0-9._%+-]"
# The same matches as the plain forms: a run's first place or the last match's end is where a match can begin,
# and possessive repeats never give back, so long runs take linear time.
FORMS = {
    "email": rf"(?:\G|(?<!{NAME})){NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must hold for a form to match at all
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# a token with a digit or an at sign may be an identifier
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT = 40
MENTIONS = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
ROUNDS, CONFIDENT, SUPPORT, ACCEPT = 3, 0.8, 3, 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The sum of the digits, every second one from the right doubled, ends in 0."""
    back = F.reverse(number)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind == "card":
        return F.when(F.length(digits(value)).between(14, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def holds(kind: str):
    return lambda m: valid(kind, m["value"])


def mentions(kind: str, gaps: str, hits: str) -> Column:
    """Places and contexts of all matches, from the matches and the texts between them."""
    step = f"""named_struct('at', s.at + length({gaps}[i - 1]) + length({hits}[i - 1]), 'out', concat(s.out, array(named_struct(
        'kind', '{kind}', 'start', s.at + length({gaps}[i - 1]), 'end', s.at + length({gaps}[i - 1]) + length({hits}[i - 1]), 'value', {hits}[i - 1],
        'before', right({gaps}[i - 1], {CONTEXT}), 'after', left({gaps}[i], {CONTEXT})))))"""
    none = f"CAST(array() AS {MENTIONS})"
    return F.expr(f"IF(coalesce(size({hits}), 0) < 1, {none}, aggregate(sequence(1, size({hits})), named_struct('at', 0, 'out', {none}), (s, i) -> {step}, s -> s.out))")


def found_in_texts(docs: DataFrame) -> DataFrame:
    """id, _text_key, base spans, and mentions (base ones and other tokens) of each row; written once."""
    text = F.col("text")
    cut = docs.select("id", F.xxhash64("text").alias("_text_key"), "text")
    forms = {**FORMS, "other": TOKEN}
    needs = {**NEEDS, "other": "[0-9@]"}
    cols = {}
    for k, form in forms.items():
        may = text.rlike(needs[k])
        cols[f"gaps_{k}"] = F.when(may, F.split(text, form, -1))
        cols[f"hits_{k}"] = F.when(may, F.regexp_extract_all(text, F.lit(form), F.lit(0)))
    cut = cut.select("id", "_text_key", *[c.alias(n) for n, c in cols.items()])
    cut = cut.select("id", "_text_key", *[mentions(k, f"gaps_{k}", f"hits_{k}").alias(k) for k in forms])
    base = F.concat(*[F.filter(F.col(k), holds(k)) for k in KINDS])
    cut = cut.select("id", "_text_key", base.alias("seeds"), "other")
    free = F.filter(F.col("other"), lambda m: ~F.exists(F.col("seeds"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    cut = cut.select("id", "_text_key", "seeds", free.alias("other"))
    return materialize(cut, "mentions")


def word(text: Column, form: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text, form, 1)), "[0-9]", "0")


def graph(found: DataFrame) -> DataFrame:
    """Edges of patterns (a word before, after, or both, for a kind) and instances, each once."""
    every = found.select(F.explode(F.concat("seeds", "other")).alias("m")).select("m.*")
    before, after = word(F.col("before"), r"(\S+)\s*$"), word(F.col("after"), r"^\s*(\S+)")
    value, number = F.col("value"), F.length(digits(F.col("value")))
    shaped = {
        "email": value.contains("@"),
        "ip": value.rlike(r"^\W*[0-9]+(?:\.[0-9]+){2,}\W*$"),
        "card": number.between(12, 19) & value.rlike(r"^[\W0-9]+$"),
        "phone": number.between(7, 15) & value.rlike(r"^[\W0-9]+$"),
    }
    kinds = F.when(F.col("kind") != "other", F.array("kind")).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in shaped.items()])))
    both = F.when((F.length("before") > 0) & (F.length("after") > 0), F.concat_ws(" ", F.lit("both"), "before", "after"))
    patterns = F.array_compact(F.array(F.when(F.length("before") > 0, F.concat(F.lit("before "), "before")), F.when(F.length("after") > 0, F.concat(F.lit("after "), "after")), both))
    every = every.select((F.col("kind") != "other").alias("seed"), F.explode(kinds).alias("kind"), "value", before.alias("before"), after.alias("after"))
    every = every.select("seed", "kind", "value", F.explode(patterns).alias("pattern"))
    return every.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))


def bootstrap(edges: DataFrame) -> DataFrame:
    """Instances (kind, value) that confident patterns discover.

    A pattern's confidence is the mean score of its instances (seeds 1, others
    what the last round gave them), an instance's score the chance that one of
    its confident patterns is right. Rounds are joins and sums over the edges.
    """
    edges = materialize(edges.withColumn("score", F.col("seed").cast("double")), "graph")
    for _ in range(ROUNDS):
        patterns = edges.groupBy("kind", "pattern").agg(F.avg("score").alias("confidence"), F.sum("score").alias("support"))
        patterns = patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT))
        scored = edges.where("NOT seed").join(patterns, ["kind", "pattern"]).groupBy("kind", "value")
        scored = scored.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("new"))
        scored = materialize(scored, "instances")
        edges = edges.join(scored, ["kind", "value"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0)))).drop("new")
    return scored.where(F.col("new") >= ACCEPT).select("kind", "value").distinct()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base spans and added spans of every row, each kind, start and end by place.

    Whole texts are searched; null counts as empty and has no spans; offsets are
    code points, ends exclusive; repeated rows get the same spans; other
    columns are not read; an empty table gives no rows.

    Base spans are seeds. The words around them are patterns, the other tokens
    with a digit or an at sign are instances that may be of a kind by their
    shape, and only patterns that at least three seeds support and eight in ten
    of their instances confirm discover such tokens.
    """
    C.session(docs)
    given = docs.select(C.quoted(id_col).alias("id"), F.coalesce(C.quoted(text_col), F.lit("")).alias("text"))
    found = found_in_texts(given)
    more = bootstrap(graph(found))
    tokens = found.select("id", "_text_key", F.explode("other").alias("m")).select("id", "_text_key", "m.value", "m.start", "m.end")
    more = tokens.join(more, "value").groupBy(F.col("id").alias("_id"), F.col("_text_key").alias("_key"))
    more = more.agg(F.collect_set(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("_added"))
    out = found.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    base = F.transform("seeds", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    order = lambda a, b: by_place(a, b, KINDS)
    return out.select(
        F.col("id").alias(id_col),
        F.array_sort(base, order).alias("base"),
        F.array_sort(F.coalesce("_added", F.expr(f"CAST(array() AS {SPANS})")), order).alias("added"),
    )
