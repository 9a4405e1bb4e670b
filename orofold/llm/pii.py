"""Personal data by weak supervision, with DataFrame functions alone.

Base spans are those of four fixed patterns whose values hold (address parts, Luhn sum, digit counts); they always stay.
The method adds spans: wider patterns propose candidates, three labelers vote on each (a regular expression
for strict form, a gazetteer of known prefixes and endings, and words standing before it), expectation-maximisation over
the counts of vote patterns estimates each labeler's reliability, and its posteriors train a naive Bayes classifier
over votes and form. A candidate becomes a span if its votes, weighed by those reliabilities, and the classifier both find it likelier than not.

Defined results: null text counts as empty; repeated rows and repeated or null doc_id give a row each; an
empty table gives an empty result; very long texts are scanned whole, in linear time (the patterns neither recurse nor
start twice within one run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, RID, numbered, rows_of, written

KINDS = ("email", "ip", "card", "phone")
#: The four patterns, written so that Java's engine scans each text once: equal matches, no recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method proposes beside matches of the base patterns that don't hold.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?[\[(]dot[\])] ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Words before a value that speak for its kind; a fixed gazetteer beside them.
CONTEXT = {
    "email": r"(?i)(e-?mail|contact|write|reach|mail)[^a-z]{0,3}(?:me |us |at |to |is |: ?)*$",
    "ip": r"(?i)(ip|host|server|address|addr)[^a-z]{0,3}(?:at |is |: ?)*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|payment)[^a-z]{0,3}(?:number |no |is |: ?)*$",
    "phone": r"(?i)(phone|tel|call|mobile|fax|cell)[^a-z]{0,3}(?:me |us |at |number |is |: ?)*$",
}
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|mil|int|info|biz|name|pro|io|co|ai|app|dev|me|tv|eu|[a-z]{2})$",
    "ip": r"^(10|127|172|192|8|1)\.",
    "card": r"^(4|5[1-5]|2[2-7]|34|37|6011|65|35)",
    "phone": r"^\+?1?[ (.-]*[2-9][0-9]{2}[) .-]+(?!0)",
}
STRICT = {
    "email": r"^\S+$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^([0-9]{4}[ -]?){3}[0-9]{1,7}$",
    "phone": r"^\+?[0-9 ]{0,4}\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$",
}
NEAR = 32
ROUNDS = 20
#: The share of true spans among candidates that EM begins with.
PRIOR = 0.5


def luhn(value: Column) -> Column:
    """True if the digits of value pass the Luhn test."""
    d = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") < 5, x.cast("int") * 2).otherwise(x.cast("int") * 2 - 9)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        part = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(\.{part}){{3}}$")
    if kind == "card":
        return F.when(digits.between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return digits.between(8, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """Of each match: its number, value, the length of the gap before it and the text near it."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.zip_with(
        F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap"), F.right(g, F.lit(NEAR)).alias("before"))),
        F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1))),
        lambda m, i: F.struct(i.alias("nth"), m["value"].alias("value"), m["gap"].alias("gap"), m["before"].alias("before")),
    )


def _tagged(kind: str, base: bool):
    return lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), m.alias("m"))


def matches(docs: DataFrame) -> DataFrame:
    """rid, kind, base (which pattern), start, end, value, before, and docs' other columns: every match,
    held or not; a row without kind for a text that has none."""
    t = F.col("t")
    keep = [c for c in docs.columns if c not in ("rid", "t")]
    specs = [(k, True, p) for k, p in BASE.items()] + [(k, False, p) for k, p in WIDE.items()]
    each = [F.when(t.rlike(p), F.transform(_found(t, p), _tagged(k, b))) for k, b, p in specs]
    rows = docs.select("rid", *keep, F.explode_outer(F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull()))).alias("x")).select("rid", *keep, "x.kind", "x.base", "x.m.*").where("kind is null or value is not null")
    to = F.sum(F.col("gap") + F.length("value")).over(_over())
    return rows.withColumn("end", to).select("rid", *keep, "kind", "base", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before")


def _over():
    from pyspark.sql import Window

    return Window.partitionBy("rid", "kind", "base").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)


def _by_kind(make) -> Column:
    out = None
    for k in KINDS:
        out = F.when(F.col("kind") == k, make(k)) if out is None else out.when(F.col("kind") == k, make(k))
    return out


def voted(found: DataFrame) -> DataFrame:
    """The three labelers' votes and the features of form beside each match."""
    return (
        found.withColumn("holds", _by_kind(lambda k: holds(k, F.col("value"))) & F.col("base"))
        .withColumn("v1", F.col("holds") | _by_kind(lambda k: F.col("value").rlike(STRICT[k])))
        .withColumn("v2", _by_kind(lambda k: F.col("value").rlike(GAZETTEER[k])))
        .withColumn("v3", _by_kind(lambda k: F.col("before").rlike(CONTEXT[k])))
        .withColumn("size", F.least(F.length("value"), F.lit(40)))
        .withColumn("digits", F.least(F.length(F.regexp_replace("value", "[^0-9]", "")), F.lit(24)))
    )


def reliabilities(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, p, a, b: by EM over the counts of vote patterns, the share of true spans and each labeler's
    chance to fire on true (a) and on other (b) candidates. A kind has 8 patterns at most, so each row folds a bounded array.
    """
    patterns = votes.groupBy("kind", "v1", "v2", "v3").agg(F.count("*").cast("double").alias("n"))
    rows = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.array(*[F.col(v).cast("double") for v in ("v1", "v2", "v3")]).alias("v"), "n"))).alias("rows"))
    fold = f"""aggregate(sequence(1, {rounds}),
      named_struct('p', {PRIOR}D, 'a', array(0.8D, 0.7D, 0.6D), 'b', array(0.3D, 0.3D, 0.05D)),
      (m, i) -> aggregate(transform(rows, r -> named_struct('v', r.v, 'n', r.n, 'q', {_posterior('r.v', 'm')})),
        named_struct('t', 1.0D, 'f', 1.0D, 'a', array(0.8D, 0.7D, 0.6D), 'b', array(0.3D, 0.3D, 0.05D)),
        (s, r) -> named_struct('t', s.t + r.n * r.q, 'f', s.f + r.n * (1 - r.q),
          'a', zip_with(s.a, r.v, (x, y) -> x + r.n * r.q * y), 'b', zip_with(s.b, r.v, (x, y) -> x + r.n * (1 - r.q) * y)),
        s -> named_struct('p', least(0.99D, greatest(0.01D, s.t / (s.t + s.f))), 'a', transform(s.a, x -> least(0.99D, greatest(0.01D, x / s.t))), 'b', transform(s.b, x -> least(0.99D, greatest(0.01D, x / s.f))))),
      m -> m)"""
    return rows.select("kind", F.expr(fold).alias("m")).select("kind", "m.*")


def _posterior(v: str, m: str) -> str:
    true = f"aggregate(zip_with({m}.a, {v}, (x, y) -> if(y > 0, x, 1 - x)), {m}.p, (c, x) -> c * x)"
    other = f"aggregate(zip_with({m}.b, {v}, (x, y) -> if(y > 0, x, 1 - x)), 1 - {m}.p, (c, x) -> c * x)"
    return f"({true} / ({true} + {other}))"


FEATURES = ("v1", "v2", "v3", "holds", "size", "digits")


def classified(votes: DataFrame) -> DataFrame:
    """votes with likely, what EM makes of a candidate's votes, and odds: the log-odds of the span classifier trained on such posteriors. Its tables hold a
    row per kind, feature and value: below 400 rows, whatever the input."""
    em = F.broadcast(reliabilities(votes))
    q = votes.groupBy("kind", *FEATURES).count().join(em, "kind").withColumn("v", F.array(*[F.col(c).cast("double") for c in ("v1", "v2", "v3")]))
    q = q.withColumn("q", F.expr(_posterior("v", "named_struct('p', p, 'a', a, 'b', b)"))).select("kind", *FEATURES, F.col("count").alias("n"), "q")
    long = q.select("kind", "n", "q", F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f).cast("string"))])).alias("feature", "value"))
    odds = long.groupBy("kind", "feature", "value").agg(F.sum(F.col("n") * F.col("q")).alias("t"), F.sum(F.col("n") * (1 - F.col("q"))).alias("f"))
    total = q.groupBy("kind").agg(F.sum(F.col("n") * F.col("q")).alias("tt"), F.sum(F.col("n") * (1 - F.col("q"))).alias("ff"))
    weights = odds.join(F.broadcast(total), "kind").select("kind", F.concat_ws("=", "feature", "value").alias("key"), F.log((F.col("t") + 0.5) / (F.col("tt") + 1) / ((F.col("f") + 0.5) / (F.col("ff") + 1))).alias("w"), F.log((F.col("tt") + 0.5) / (F.col("ff") + 0.5)).alias("bias"))
    model = weights.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("key", "w"))).alias("model"), F.first("bias").alias("bias"))
    keyed = votes.join(F.broadcast(model), "kind", "left").join(em, "kind", "left").withColumn("v", F.array(*[F.col(c).cast("double") for c in ("v1", "v2", "v3")]))
    keyed = keyed.withColumn("likely", F.expr(_posterior("v", "named_struct('p', p, 'a', a, 'b', b)"))).drop("v", "p", "a", "b")
    parts = [F.coalesce(F.element_at("model", F.concat(F.lit(f + "="), F.col(f).cast("string"))), F.lit(0.0)) for f in FEATURES]
    return keyed.withColumn("odds", sum(parts, F.coalesce("bias", F.lit(0.0)))).drop("model", "bias")


def spans(docs: DataFrame) -> DataFrame:
    """kind, start, end, base for each span found, beside docs' columns but t (rid, t and others): code points,
    end exclusive. A text without any has a row without kind.

    An added span is likely by its votes and by the classifier, and overlaps no base span of its kind."""
    keep = [c for c in docs.columns if c != "t"]
    all_votes = written(voted(matches(docs)), "pii-votes")
    votes = all_votes.where("kind is not null")
    told = classified(votes).where(F.col("holds") | ((F.col("odds") > 0) & (F.col("likely") > 0.5)))
    from pyspark.sql import Window

    before = Window.partitionBy("rid", "kind").orderBy(F.col("start"), F.col("end").desc())
    reach = F.max(F.when(F.col("holds"), F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("holds"), F.col("start"))).over(before.rowsBetween(1, Window.unboundedFollowing))
    kept = told.withColumn("reach", F.coalesce(reach, F.lit(-1))).withColumn("ahead", F.coalesce(ahead, F.lit(1 << 40)))
    kept = kept.where(F.col("holds") | ((F.col("reach") <= F.col("start")) & (F.col("ahead") >= F.col("end")))).select(*keep, "kind", F.col("start").cast("long"), F.col("end").cast("long"), F.col("holds").alias("base"))
    return kept.distinct().unionByName(all_votes.select(*keep).distinct().select(*keep, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("boolean").alias("base")))


def find_pii(docs: DataFrame) -> DataFrame:
    """rid, doc_id, spans: array of (kind, start, end, base), by kind as listed, then start."""
    rows = rows_of(docs, "doc_id", "text").select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(order.alias("order"), "start", "end", "kind", "base"))
    return spans(rows).groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    n = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span's text replaced by its kind in square brackets; overlapping spans become one."""
    names = docs.columns
    rows = numbered(docs)
    own = OWN + "spans"
    found = spans(rows.select(F.col(RID).alias("rid"), F.coalesce("text", F.lit("")).alias("t"))).where("kind is not null").groupBy(F.col("rid").alias(RID)).agg(F.array_sort(F.collect_list(F.struct("start", F.col("end").alias("stop"), "kind"))).alias(own))
    out = rows.join(found, RID, "left")
    # A fold keeps what is written so far and how far the text is used up.
    fold = f"""aggregate(coalesce({own}, array()), named_struct('parts', cast(array() as array<string>), 'at', 0L),
      (s, x) -> if(x.stop <= s.at, s, named_struct('parts', concat(s.parts, array(substring(text, cast(s.at + 1 as int), cast(greatest(0L, x.start - s.at) as int)), if(x.start < s.at, '', concat('[', upper(x.kind), ']')))), 'at', x.stop)),
      s -> concat(array_join(s.parts, ''), substring(text, cast(s.at + 1 as int))))"""
    out = out.withColumn("text", F.when(F.col(own).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.expr(fold)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
