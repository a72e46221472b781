r"""Secret scan with multipart credential linking; DataFrame and SQL functions only.

Base spans: assignments of a value to a secret's name, access identifiers, and long hexadecimal
strings; these are always reported. Weak candidates are strings that alone say little: other
access-like identifiers, account names, shorter or base64-like secret strings, and endpoints. They
are linked by an interval join within scopes: a scope is the stretch of ``reach`` code points
around a weak candidate, and the candidate is reported only if the complementary parts lie in it:

    identifier   needs a secret (weak or base assign or hex) in scope
    secret       needs an identifier (weak or base access) in scope
    endpoint     needs both

Weak candidates have a least length and no largest one: they end where their characters do. One
that lies inside a base span is that span; one that reaches beyond is a candidate of its own.

Matches and their places come from two built-in functions that walk the text alike: the matches,
and the pieces between them; running sums of their lengths are the places, in code points. All
of it stays in the row, so there is no shuffle and a document is the largest unit of work. Running
sums go over blocks of about sqrt(m) of m matches, and the interval join asks only those blocks of parts
that reach into a scope, so a text of m matches takes m sqrt(m) steps, not m^2. A text without any base
or weak match costs one pass for each kind.

Defined results: null or empty text has no spans (empty string, and the hash of the empty
string); a null ``doc_id`` is kept; rows that repeat give rows that repeat; other columns are
ignored unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A match of ACCESS or HEX of at least the least length is a match of these, and the other way round.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

# weak candidates, named as they are reported
IDENTIFIER = r"\b(?:ASIA|AIDA|AROA|AGPA|ANPA|AKIA)[A-Z0-9]{8,}+\b|\b(?i:client_?id|account(?:_?id)?|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}+"
STRONG_STRING = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])|(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])"
ENDPOINT = r"\b(?i:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]{4,}+"

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SPAN = "array<struct<s:int,e:int,k:int>>"
CHUNK = 1024  # code points


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once and not for each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each block of about sqrt(m) of the m items."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), width)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: use(F.slice(items, i, width)))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers what ``join`` makes of 0 and those before it."""
    none = F.expr("cast(array() as array<int>)")

    def block(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out"))

    def behind(acc: Column, p: Column) -> Column:
        return F.struct(join(acc["at"], p["at"]).alias("at"), F.array_append(acc["out"], F.transform(p["out"], lambda o: join(acc["at"], o))).alias("out"))

    return _let(values, lambda v: F.aggregate(_blocks(v, block), first, behind, lambda acc: F.flatten(acc["out"])))


def places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans ``(s, e, k)`` of all matches, leftmost and without overlap; ``keep`` tests the match."""
    none = F.expr(f"cast(array() as {SPAN})")

    def spans(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(matches, between, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("ok")))

        def placed(p: Column) -> Column:
            before = running(F.transform(p, lambda x: x["gap"] + x["n"]), lambda x, y: x + y)
            found = F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), F.lit(kind).alias("k"), x["ok"].alias("ok")))
            return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))

        return _let(pairs, placed)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def _indexed(parts: Column) -> Column:
    """Blocks of spans in order of their starts, with their least start and largest end."""
    return _let(F.array_sort(parts), lambda p: _blocks(p, lambda b: F.struct(F.get(b, F.lit(0))["s"].alias("lo"), F.array_max(F.transform(b, lambda x: x["e"])).alias("hi"), b.alias("held"))))


def _in_scope(span: Column, parts: Column, reach: int) -> Column:
    """Is there a part other than the span itself within ``reach`` code points of it?"""
    near = lambda p: (p["s"] <= span["e"] + reach) & (p["e"] >= span["s"] - reach) & ((p["e"] <= span["s"]) | (p["s"] >= span["e"]))
    return F.exists(parts, lambda b: (b["lo"] <= span["e"] + reach) & (b["hi"] >= span["s"] - reach) & F.exists(b["held"], near))


def _apart(weak: Column, base: Column) -> Column:
    """Weak spans that lie inside no base span."""
    inside = lambda w, b: F.exists(b["held"], lambda p: (p["s"] <= w["s"]) & (w["e"] <= p["e"]))
    return F.filter(weak, lambda w: ~F.exists(base, lambda b: (b["lo"] <= w["s"]) & (w["e"] <= b["hi"]) & inside(w, b)))


def spans_of(docs: DataFrame, reach: int = 200, keep: bool = False) -> DataFrame:
    """``doc_id``, arrays ``base`` and ``linked`` of spans, and with ``keep`` the whole row as ``row``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    rows = docs.select("doc_id", *row, text.alias("_text"))
    rows = rows.select("*", places(F.col("_text"), ASSIGN, 0, value).alias("_a"), places(F.col("_text"), ACCESS_LONG, 1).alias("_i"), places(F.col("_text"), HEX_LONG, 2).alias("_h"))
    rows = rows.withColumn("base", F.array_sort(F.concat("_a", "_i", "_h")))
    rows = rows.select("*", *[places(F.col("_text"), p, k).alias(n) for k, (n, p) in enumerate((("_wi", IDENTIFIER), ("_ws", STRONG_STRING), ("_we", ENDPOINT)), 3)])
    rows = rows.withColumn("_base", _indexed(F.col("base")))
    rows = rows.select("*", *[_apart(F.col(n), F.col("_base")).alias(n[1:]) for n in ("_wi", "_ws", "_we")])
    identifiers, secrets = F.concat("wi", "_i"), F.concat("ws", "_a", "_h")
    rows = rows.select("*", _indexed(identifiers).alias("_ids"), _indexed(secrets).alias("_secrets"))
    linked = F.concat(
        F.filter("wi", lambda w: _in_scope(w, F.col("_secrets"), reach)),
        F.filter("ws", lambda w: _in_scope(w, F.col("_ids"), reach)),
        F.filter("we", lambda w: _in_scope(w, F.col("_ids"), reach) & _in_scope(w, F.col("_secrets"), reach)),
    )
    rows = rows.withColumn("linked", F.array_sort(linked))
    return rows.select("doc_id", *(["row"] if keep else []), "_a", "_i", "_h", "base", "linked")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def by_place(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.transform(ordered, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Counts of base spans, their digest and all spans of each document."""
    rows = spans_of(docs, reach)
    return rows.select(
        "doc_id",
        F.size("_a").cast("long").alias("n_assign"),
        F.size("_i").cast("long").alias("n_access"),
        F.size("_h").cast("long").alias("n_hex"),
        F.sha2(joined(by_place(F.col("base"))), 256).alias("base_sha256"),
        joined(by_place(F.concat("base", "linked"))).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """``docs`` with every base and linked span of ``text`` replaced by ``mask``; other columns stay."""
    rows = spans_of(docs, reach, keep=True)
    text = F.col("row.text")
    # pieces are cut from chunks of the text, as places are counted from the start of a string
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def piece(parts: Column, s: Column, e: Column) -> Column:
        first, last = F.floor(s / CHUNK).cast("int"), F.floor((e - 1) / CHUNK).cast("int")
        cut = lambda i: F.substring(F.get(parts, i), F.greatest(F.lit(0), s - i * CHUNK) + 1, F.least(F.lit(CHUNK), e - i * CHUNK) - F.greatest(F.lit(0), s - i * CHUNK))
        return F.when(e > s, F.array_join(F.transform(F.sequence(first, last), cut), "")).otherwise(F.lit(""))

    def masked(spans: Column, parts: Column) -> Column:
        done = running(F.transform(spans, lambda x: x["e"]), F.greatest)
        # a span that begins inside one before only extends it
        heads = F.zip_with(spans, done, lambda x, at: F.when(x["s"] >= at, F.concat(piece(parts, at, x["s"]), F.lit(mask))).otherwise(F.lit("")))
        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.concat(F.array_join(heads, ""), piece(parts, end, F.length(text)))

    cut = _let(by_place(F.concat("base", "linked")), lambda spans: _let(chunks, lambda parts: masked(spans, parts)))
    new = F.when(F.size("base") + F.size("linked") > 0, cut).otherwise(text)
    return rows.select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
