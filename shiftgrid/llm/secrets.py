"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong parts (assignments, access ids, long hex numbers) are always reported. Weak parts (user or client ids, short assigned
secrets, bare long tokens, endpoints) are reported only when their complement stands in the same scope, that is, within ``reach``
code points of them in one document: an id needs a secret, a secret needs an id, an endpoint needs both. The interval join that
decides this is a running maximum of ends from the left and a running minimum of starts from the right, over the parts of a
document in order: exact, and without a row per pair. The parts are an array beside their document, which stays in its task: no
text is shuffled or sorted.

Positions come from the pieces between matches: lengths of gaps and matches are summed in order. Null and empty texts hold
nothing; overlapping strong parts of different kinds are all reported; ties are ordered by kind; repeated rows are reported
alike. Columns besides those kept and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.common import need

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# kind -> (pattern, group whose length counts, least length, strong?, what the part is)
KINDS = {
    "assign": (ASSIGN, 2, 8, True, "secret"),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16, True, "id"),
    "hex": (r"[0-9a-f]{32,}", 0, 32, True, "secret"),
    "login": (r"""(?i)\b(user(?:_?name|_?id)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""",
              2, 3, False, "id"),
    "short": (r"""(?i)\b(password|passwd|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,7})(?![A-Za-z0-9+/_.=-])""",
              2, 4, False, "secret"),
    "bare": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}", 0, 24, False, "secret"),
    "endpoint": (r"(?i)\b(?:https?|ssh|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", 0, 8, False, "endpoint"),
}
BASE = ("assign", "access", "hex")
REACH = 200


# Types of the elements of arrays: lengths of a match, a placed part, and a part with what is within reach to its right.
MATCH = "struct<gap:int,size:int,counts:boolean>"
PART = "struct<start:bigint,order:int,end:bigint,kind:string,strong:boolean,role:string>"
RIGHT = f"struct<part:{PART},secret:boolean,id:boolean>"
# Elements appended to one array before the next is begun.
BLOCK = 256


def running(rows: Column, row_type: str, seen_type: str, fold, first: Column | None = None) -> Column:
    """Array of (row, seen) for an array of rows, ``seen`` being what ``fold(seen, row)`` made of all rows before.

    Appending copies an array, so states are gathered in blocks: the work grows with the rows, not with their square. ``fold``
    is also called once with a null row, for which it must return what it got.
    """
    state = f"struct<row:{row_type},seen:{seen_type}>"
    nothing = F.struct(F.lit(None).cast(row_type).alias("row"), (F.lit(None) if first is None else first).cast(seen_type).alias("seen"))

    def step(s: Column, row: Column) -> Column:
        last, full = F.element_at(s["block"], -1), F.size(s["block"]) >= BLOCK
        new = F.array(F.struct(row.alias("row"), fold(last["seen"], last["row"]).alias("seen")))
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["block"]))).otherwise(s["done"]).alias("done"),
                        F.when(full, new).otherwise(F.concat(s["block"], new)).alias("block"))

    begin = F.struct(F.expr(f"cast(array() as array<array<{state}>>)").alias("done"), F.array(nothing).alias("block"))
    states = F.aggregate(rows, begin, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["block"]))))
    return F.filter(states, lambda s: s["row"].isNotNull())


def placed(text: Column, order: int, kind: str) -> Column:
    """Array of the parts of one kind that are long enough, with their places."""
    pattern, group, least, strong, role = KINDS[kind]
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in sorted({0, group})]
    matches = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), *groups), lambda x: F.struct(  # the last gap has no match
        F.length(x["gap"]).alias("gap"), F.length(x["g0"]).alias("size"), (F.length(x[f"g{group}"]) >= least).alias("counts")))
    ends = running(matches, MATCH, "bigint", lambda end, m: end + F.coalesce(m["gap"] + m["size"], F.lit(0)), F.lit(0))

    def part(x: Column) -> Column:
        start = x["seen"] + x["row"]["gap"]
        return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["row"]["size"]).alias("end"), F.lit(kind).alias("kind"),
                        F.lit(strong).alias("strong"), F.lit(role).alias("role"))

    return F.when(text.rlike(pattern), F.transform(F.filter(ends, lambda x: x["row"]["counts"]), part))


def parts_of(text: Column) -> Column:
    """Array of the parts of every kind, ordered by start, then kind."""
    empty = F.expr(f"cast(array() as array<{PART}>)")
    return F.array_sort(F.concat(*[F.coalesce(placed(text, order, kind), empty) for order, kind in enumerate(KINDS)]))


def linked(parts: Column, reach: int) -> Column:
    """Of the ordered parts those that are reported, in order."""
    def within(distance: Column) -> Column:
        return F.coalesce(distance <= reach, F.lit(False))

    def rows(states: Column) -> Column:
        return F.transform(states, lambda x: x["row"])

    # a weak part that overlaps a strong one is the same thing seen twice; it neither counts nor complements
    ends = running(parts, PART, "bigint", lambda end, p: F.greatest(end, F.when(p["strong"], p["end"])))
    whole = rows(F.filter(ends, lambda x: x["row"]["strong"] | ~F.coalesce(x["seen"] > x["row"]["start"], F.lit(False))))
    starts = running(F.reverse(whole), PART, "bigint", lambda start, p: F.least(start, F.when(p["strong"], p["start"])))
    whole = rows(F.filter(starts, lambda x: x["row"]["strong"] | ~F.coalesce(x["seen"] < x["row"]["end"], F.lit(False))))

    def nearest(pick, place: str, part):
        """Per role, the largest or smallest place of its parts."""
        return lambda seen, x: F.struct(*[
            pick(seen[role], F.when(part(x)["role"] == role, part(x)[place])).alias(role) for role in ("secret", "id")])

    right = running(whole, PART, "struct<secret:bigint,id:bigint>", nearest(F.least, "start", lambda x: x))
    right = F.transform(right, lambda x: F.struct(
        x["row"].alias("part"), *[within(x["seen"][role] - x["row"]["end"]).alias(role) for role in ("secret", "id")]))
    both = running(F.reverse(right), RIGHT, "struct<secret:bigint,id:bigint>", nearest(F.greatest, "end", lambda x: x["part"]))

    def reported(x: Column) -> Column:
        part = x["row"]["part"]
        secret, name = [x["row"][role] | within(part["start"] - x["seen"][role]) for role in ("secret", "id")]
        return part["strong"] | F.when(part["role"] == "id", secret).when(part["role"] == "secret", name).otherwise(secret & name)

    return F.transform(F.filter(both, reported), lambda x: x["row"]["part"])


def scan(docs: DataFrame, keep: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: ``keep`` and ``parts``, the reported parts as (kind, start, end, strong), in order.

    ``start`` and ``end`` count code points, end exclusive.
    """
    need(docs, text, *keep)
    found = docs.select(F.struct(*keep).alias("_doc"), parts_of(F.col(text)).alias("_parts"))
    return found.select("_doc.*", F.transform(linked(F.col("_parts"), reach), lambda p: F.struct(
        p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["strong"].alias("strong"))).alias("parts"))


def of_kind(parts: Column, kind: str) -> Column:
    """How many parts are of a kind."""
    return F.size(F.filter(parts, lambda p: p["kind"] == kind)).cast("long")


def listed(parts: Column) -> Column:
    """kind:start:end of the parts, comma-joined."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")


def redacted(text: Column, parts: Column, mark: str = "[SECRET]") -> Column:
    """The text with every part replaced by a mark; overlapping parts share one."""
    state = F.aggregate(
        parts, F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at")),
        lambda s, p: F.when(p["start"] >= s["at"], F.struct(
            F.concat(s["text"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), F.lit(mark)).alias("text"), p["end"].alias("at")))
        .otherwise(F.struct(s["text"].alias("text"), F.greatest(s["at"], p["end"]).alias("at"))))
    return F.when(F.size(parts) > 0, F.concat(
        state["text"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)
