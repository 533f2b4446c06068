"""Secret scan: credentials put together from their parts.

Three strong kinds are reported wherever they stand: assigned secrets, access identifiers
and long hexadecimal strings. Three weak kinds (account names, mixed tokens, endpoints)
are everyday text on their own. They are joined by interval with the parts around them: a
weak part is reported only if a part that complements it starts within ``SCOPE`` code
points, so that an identifier, a secret and an endpoint confirm each other.

The join is a range window over the parts of one document ordered by start. It makes no
pairs: a frame holds the parts of one scope, whose number is bounded by the scope's length.
All of it is DataFrame expressions. Texts are read once; what is joined is a written table
of positions.

Defined results: a null text is empty and has no parts; rows are never merged, so repeated
rows or repeated ids give a result each; an empty table gives an empty result; other columns
of the input are ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import let, text_of, written

SCOPE = 200  # code points between the starts of parts that belong together

ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ACCOUNT = (
    r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|app_?id|tenant_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
)
_WORD = r"[A-Za-z0-9+/_-]"
MIXED = rf"(?<!{_WORD})(?={_WORD}{{20}})(?={_WORD}*[0-9])(?={_WORD}*[A-Z])(?={_WORD}*[a-z]){_WORD}{{20,}}+"
ENDPOINT = (
    r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])"""
)

# Kinds in the order of the report; role of each part.
KINDS = ["assign", "access", "hex", "account", "mixed", "endpoint"]
STRONG = KINDS[:3]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "account"), ("assign", "hex", "mixed"), ("endpoint",)
# A weak kind -> the parts that confirm it.
COMPLEMENTS = {"account": SECRETS, "mixed": IDENTIFIERS + ENDPOINTS, "endpoint": SECRETS}

SPANS = "array<struct<start: bigint, kind: int, end: bigint>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """Sum of the elements before each element, by blocks of about the root of the length."""

    def by_blocks(v: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(v))).cast("int")

        def blocks(b: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda j: _sum(F.slice(v, j * b + 1, b)))
            before = let(sums, lambda s: F.transform(s, lambda _, j: _sum(F.slice(s, F.lit(1), j))))
            return let(
                before,
                lambda p: F.transform(
                    v, lambda _, i: p[F.floor(i / b).cast("int")] + _sum(F.slice(v, F.floor(i / b).cast("int") * b + 1, i % b))
                ),
            )

        return let(block, blocks)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(by_blocks(v)))


def located(text: Column, pattern: str, kind: str, least: tuple[int, int] | None = None) -> Column:
    """Spans of the leftmost matches that do not overlap.

    Matches and the pieces between them alternate, so their lengths give the positions.
    ``least`` is a group and the length below which its match is dropped afterwards.
    """
    number = KINDS.index(kind)
    regex = F.lit(pattern)

    def spans(m: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

        def placed(g: Column) -> Column:
            steps = prefix_sums(F.transform(m, lambda x, i: g[i] + F.length(x)))
            return let(
                steps,
                lambda s: F.transform(
                    m,
                    lambda x, i: F.struct(
                        (s[i] + g[i]).cast("bigint").alias("start"),
                        F.lit(number).alias("kind"),
                        (s[i] + g[i] + F.length(x)).cast("bigint").alias("end"),
                    ),
                ),
            )

        all_spans = let(pieces, placed)
        if least is None:
            return all_spans
        group, length = least
        values = F.regexp_extract_all(text, regex, group)
        return let(values, lambda v: F.filter(all_spans, lambda _, i: F.length(v[i]) >= length))

    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, regex, F.lit(0)), spans)).otherwise(none)


def _part_columns(text: Column) -> list[Column]:
    base = F.concat(
        located(text, ASSIGN, "assign", (2, 8)), located(text, ACCESS, "access"), located(text, HEX, "hex")
    )
    weak = F.concat(
        located(text, ACCOUNT, "account"), located(text, MIXED, "mixed"), located(text, ENDPOINT, "endpoint")
    )
    return [F.sort_array(base).alias("strong"), weak.alias("weak")]


def found_parts(docs: DataFrame) -> DataFrame:
    """``(doc_id, _row, strong, weak)``: spans of every text, written; ``_row`` names the row."""
    texts = docs.select("doc_id", text_of("text").alias("_text"))
    return written(
        texts.select("doc_id", F.monotonically_increasing_id().alias("_row"), *_part_columns(F.col("_text"))), "secret-parts"
    )


def linked(parts: DataFrame) -> DataFrame:
    """``(_row, linked)``: weak spans that a complementary part confirms, by row."""
    rows = parts.filter(F.size("weak") > 0).select("_row", F.explode(F.concat("strong", "weak")).alias("p"))
    rows = rows.select("_row", "p.*").withColumn("name", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))
    own = Window.partitionBy("_row")
    # Strong parts come first among equal starts, hence the order by kind.
    up, down = own.orderBy("start", "kind"), own.orderBy(F.desc("start"), F.desc("kind"))
    scope = own.orderBy("start").rangeBetween(-SCOPE, SCOPE)
    strong = F.col("name").isin(STRONG)
    marked = rows.withColumns(
        {
            "reached": F.max(F.when(strong, F.col("end"))).over(up),
            "next": F.min(F.when(strong, F.col("start"))).over(down),
            **{f"near_{k}": F.max(F.col("name").isin(*c)).over(scope) for k, c in COMPLEMENTS.items()},
        }
    )
    confirmed = F.lit(False)
    for kind in COMPLEMENTS:
        confirmed = confirmed | ((F.col("name") == kind) & F.col(f"near_{kind}"))
    # What overlaps a strong part is that part, said twice.
    apart = (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & (
        F.col("next").isNull() | (F.col("next") >= F.col("end"))
    )
    spans = marked.filter(~strong & confirmed & apart)
    return spans.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def _said(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the strong spans, all spans, number of linked ones."""
    parts = found_parts(docs)
    rows = parts.join(linked(parts), "_row", "left")
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    extra = F.coalesce(F.col("linked"), F.array().cast(SPANS))
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(_said(F.col("strong")), 256).alias("base_sha256"),
        _said(F.sort_array(F.concat("strong", extra))).alias("spans"),
        F.size(extra).cast("bigint").alias("n_linked"),
    )


def _redacted(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each span; spans that overlap share one mask or stand side by side."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["end"] <= state["at"], state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mask))).alias("out"),
        )

    done = F.aggregate(spans, start, step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))


def masked_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by ``mask``; rows and columns stay.

    Only documents with a part of some kind are written and joined; the rest pass through.
    """
    columns = docs.columns
    suspect = F.coalesce(F.col("text").rlike("|".join([ASSIGN, ACCESS, HEX, ACCOUNT, MIXED, ENDPOINT])), F.lit(False))
    rows = docs.filter(suspect).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col("text").alias("_text"))
    parts = written(
        rows.select("_doc", F.monotonically_increasing_id().alias("_row"), *_part_columns(F.col("_text"))), "secret-suspects"
    )
    found = parts.join(linked(parts), "_row", "left").withColumn(
        "_spans", F.sort_array(F.concat("strong", F.coalesce(F.col("linked"), F.array().cast(SPANS))))
    )
    text = _redacted(F.col("_doc.text"), F.col("_spans"), mask)
    cleaned = found.select(*[text.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in columns])
    return docs.filter(~suspect).unionByName(cleaned)
