"""Secret scan: base patterns, and weak candidates that need a partner nearby.

A credential is often in parts: an access identifier, a secret, the endpoint they open.
Strong patterns are reported wherever they stand.  A weak candidate (a token that may be
a secret, an account name, an address) is reported only where complementary parts stand in
the same scope.  The scopes are joined by a sweep over a document's spans in order of
position, as counts over a range of positions, so no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key

#: kind, pattern, group that must have ``least`` characters, least; in the order of reports.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Weak candidates.  A run of at least 20 token characters that has a digit and letters of
#: both cases; an account name; the address of a service.
WEAK = (
    ("key", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    ("account", r"""(?i:(username|user_?id|account|login|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3),
    ("endpoint", r"(?i:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+", 0, 8),
)
KINDS = BASE + WEAK
#: Which part of a credential a kind is.
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "account"), ("assign", "hex", "key"), ("endpoint",)


def _matches(text: Column, at: int) -> Column:
    """Matches of one kind in order: kind, number of the match, characters before it since the last, its own, whether it holds.

    Matches and the text between them alternate, so a place is the length of all before it;
    that sum is left to a window, as a fold over the matches would copy what it has found.
    """
    kind, pattern, group, least = KINDS[at]
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.transform(found, lambda m: m).alias("m"), F.transform(tested, lambda m: m).alias("g"),
                          F.transform(F.slice(between, 1, F.size(found)), lambda m: F.length(m)).alias("gap"))
    parts = F.transform(zipped, lambda x, i: F.struct(F.lit(at).alias("kind"), i.alias("at"), (x["gap"] + F.length(x["m"])).alias("step"), x["m"].alias("value"),
                                                      _holds(kind, x["m"], x["g"], least).alias("holds")))
    # most texts have no match: a search for one costs less than taking the text apart
    return F.when(F.regexp_like(text, F.lit(pattern)), parts).otherwise(
        F.array().cast("array<struct<kind:int,at:int,step:int,value:string,holds:boolean>>"))


def _holds(kind: str, match: Column, group: Column, least: int) -> Column:
    long_enough = F.length(group) >= least
    if kind == "key":
        return long_enough & F.regexp_like(match, F.lit("[0-9]")) & F.regexp_like(match, F.lit("[A-Z]")) & F.regexp_like(match, F.lit("[a-z]"))
    return long_enough


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per document: doc_id, text_key and ``spans``, an array of structs kind, start, end, value, linked.

    Positions are code points of the text, ends exclusive; sorted by start, then kind as in
    ``KINDS``.  Base kinds are always there.  A weak candidate is there if complementary parts
    stand at most ``scope`` code points before its start or after its end, base or weak alike:
    a ``key`` needs an identifier, an ``account`` a secret, an ``endpoint`` both.  A weak
    candidate that overlaps a base span is that span: it is not reported and no part.
    ``linked`` says whether a span has its complementary parts in its scope.  Null and empty
    texts have no spans.  A document is a doc_id with a text, also where doc_id is null: equal
    rows are one, different texts of one doc_id never meet.  Time is linear in a text but for
    sorting its spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_key(text).alias("text_key"), text.alias("text"))
    # each document has a row of its own besides its matches, whether they hold or not; one shuffle serves all windows
    own = F.array(F.lit(None).cast("struct<kind:int,at:int,step:int,value:string,holds:boolean>"))
    found = rows.select("doc_id", "text_key", F.concat(own, *[_matches(F.col("text"), i) for i in range(len(KINDS))]).alias("found"))
    one = ["doc_id", "text_key"]
    flat = found.select(*one, F.explode("found").alias("m")).select(*one, "m.*").distinct().repartition(*one)
    behind = Window.partitionBy(*one, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = flat.withColumn("end", F.sum("step").over(behind).cast("int")).where("holds or kind is null")
    flat = flat.select(*one, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")
    # running frames only: the first start after is read in descending order
    upto = Window.partitionBy(*one).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*one).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*one).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    number = {k[0]: i for i, k in enumerate(KINDS)}
    among = lambda kinds: F.col("kind").isin(*[number[k] for k in kinds])
    base = F.col("kind") < len(BASE)
    placed = flat.select("*", F.max(F.when(base, F.col("end"))).over(before).alias("base_end"),
                         F.min(F.when(base, F.col("start"))).over(after).alias("base_start"))
    apart = (F.coalesce("base_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    placed = placed.withColumn("part", base | apart)

    def near(kinds: tuple[str, ...]) -> Column:
        """Whether the last end before, or the first start after, leaves a gap of at most the scope."""
        which = among(kinds) & F.col("part")
        last, first = F.max(F.when(which, F.col("end"))).over(upto), F.min(F.when(which, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= scope, F.lit(False)) | F.coalesce(first - F.col("end") <= scope, F.lit(False))

    linked = placed.select("*", near(IDENTIFIERS).alias("identifier"), near(SECRETS).alias("secret"))
    complete = (F.when(among(IDENTIFIERS), F.col("secret")).when(among(ENDPOINTS), F.col("identifier") & F.col("secret"))
                .otherwise(F.col("identifier")))
    shown = linked.withColumn("shown", F.col("kind").isNotNull() & (base | (F.col("part") & complete)))
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("number"), name.alias("kind"), "end", "value", complete.alias("linked"))
    return shown.groupBy(*one).agg(F.array_sort(F.collect_list(F.when(F.col("shown"), span))).alias("spans"))


def redact(docs: DataFrame, mask: str = "[redacted]", scope: int = 200) -> DataFrame:
    """The documents with the columns of ``docs`` and every reported span replaced by ``mask``.

    Spans that overlap are one.  Null texts stay null.
    """
    one = [F.col("doc_id"), F.col("text_key")]
    spans = find_secrets(docs, scope).select(*one, F.inline("spans"))
    ahead = F.coalesce(F.max("end").over(Window.partitionBy(*one).orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = spans.select(*one, "start", "number", "end", ahead.alias("done")).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "number", "done", F.greatest("end", "done").alias("end")))).alias("__cuts"))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["__id"]) & (text_key(docs["text"]) == cuts["__key"]), "left")
    # four bytes a character, so that a stretch is found without reading what is before it; bound once, as ``wide``
    text = F.expr("""
        element_at(transform(array(encode(text, 'UTF-32')), wide -> concat(
            array_join(transform(__cuts, c -> if(c.start < c.done, '',
                concat(decode(substring(wide, 4 * c.done + 1, 4 * (c.start - c.done)), 'UTF-32'), {mask}))), ''),
            decode(substring(wide, 4 * element_at(__cuts, -1).end + 1, length(wide)), 'UTF-32'))), 1)""".replace(
        "{mask}", "'" + mask.replace("\\", "\\\\").replace("'", "\\'") + "'"))
    text = F.when(F.col("__cuts").isNotNull(), text).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
