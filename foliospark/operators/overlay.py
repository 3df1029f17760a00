"""Corrections laid over recognised boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank, let, trim

#: Boxes merge across a gap of at most so many line heights, on lines that differ by at most the other share.
MOST_GAP = 1.5
SAME_LINE = 0.5


def known_only(corrections: DataFrame, boxes: DataFrame, by: list[str], box: str = "id") -> DataFrame:
    """Corrections of boxes that were asked for."""
    return corrections.join(boxes.select(*by, box), [*by, box], "left_semi")


def last_of_each(corrections: DataFrame, by: list[str], box: str = "id", text: str = "text", order: str = "seq") -> DataFrame:
    """by, box, text, order: of several corrections of a box the last text, at the place of the first."""
    return corrections.groupBy(*by, box).agg(F.max_by(text, order).alias(text), F.min(order).alias(order))


def overlaid(items: DataFrame, corrections: DataFrame, by: list[str], box: str = "id", text: str = "text") -> DataFrame:
    """items with `current`: the corrected text where there is one, an empty one included, else the item's own."""
    fixes = corrections.select(*by, box, F.col(text).alias("__new"))
    return items.join(fixes, [*by, box], "left").withColumn("current", F.coalesce("__new", text)).drop("__new")


def laid_over(boxes: Column, corrections: Column) -> Column:
    """Boxes of one page (array of structs id, text; each id once) as structs id, text, current, in the order of ids.

    corrections: array of structs id, text in the order in which they came. The last of each box counts, an empty text
    too; those of boxes that aren't there, or with a null id or text, are passed over. Both arrays are sorted, so a page
    costs n log n, and nothing is shuffled. Null for null boxes; null corrections are none.
    """
    given = F.filter(corrections, lambda c: c["id"].isNotNull() & c["text"].isNotNull())
    placed = F.array_sort(F.transform(given, lambda c, i: F.struct(c["id"].cast("long").alias("id"), i.alias("place"), c["text"].alias("text"))))
    last = let(placed, lambda all_: F.filter(all_, lambda c, i: F.coalesce(F.get(all_, i + 1)["id"] != c["id"], F.lit(True))))

    def row(c, kind):
        return F.struct(c["id"].cast("long").alias("id"), F.lit(kind).alias("kind"), c["text"].alias("text"))

    none = F.array().cast("array<struct<id:bigint,kind:int,text:string>>")
    both = F.array_sort(F.concat(F.transform(boxes, lambda b: row(b, 0)), F.coalesce(F.transform(last, lambda c: row(c, 1)), none)))

    def laid(all_):
        def entry(b, i):
            after = F.get(all_, i + 1)
            new = F.when((after["kind"] == 1) & (after["id"] == b["id"]), after["text"])
            return F.struct(b["id"].alias("id"), b["kind"].alias("kind"), b["text"].alias("text"), F.coalesce(new, b["text"]).alias("current"))

        return F.transform(F.filter(F.transform(all_, entry), lambda b: b["kind"] == 0), lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"), b["current"].alias("current")))

    return let(both, laid)


def live(items: DataFrame, current: str = "current") -> DataFrame:
    """Items whose current text isn't blank: what the next pass gets to see."""
    return items.where(~is_blank(F.col(current)))


def differs(new: Column, old: Column) -> Column:
    return trim(F.coalesce(new, F.lit(""))) != trim(F.coalesce(old, F.lit("")))


def real_changes(items: DataFrame, current: str = "current", text: str = "text") -> DataFrame:
    """Items that differ from what was recognised; changes that were taken back are gone."""
    return items.where(differs(F.col(current), F.col(text)))


def widened(pages: DataFrame, items: str = "items") -> DataFrame:
    """pages whose items (arrays of structs id, str, text, transform, width) that took in the text of emptied neighbours
    have the width of all of them.

    An item whose text has grown looks left, then right, over the emptied items next to it, for as long as they lie on its
    line and the gap is small. The first that doesn't ends the search on its side.
    """
    def emptied(n):
        return ~is_blank(n["str"]) & is_blank(n["text"])

    def entry(item, i):
        a, b, c, d, e, f = (F.get(item["transform"], F.lit(k)) for k in range(6))
        along, tall = F.hypot(a, b), F.hypot(c, d)

        def span(line, n):
            dx, dy = F.get(n["transform"], F.lit(4)) - line["e"], F.get(n["transform"], F.lit(5)) - line["f"]
            t = line["ux"] * dx + line["uy"] * dy
            return F.abs(line["ux"] * dy - line["uy"] * dx) <= line["tall"] * SAME_LINE, t, t + n["width"]

        def walk(line, neighbours, start, leftwards):
            def step(state, n):
                same, low, high = span(line, n)
                gap = state["edge"] - high if leftwards else low - state["edge"]
                goes = state["open"] & emptied(n) & same & (gap <= line["tall"] * MOST_GAP)
                edge = F.least(state["edge"], low) if leftwards else F.greatest(state["edge"], high)
                return F.when(state["open"], let(goes, lambda g: F.struct(F.when(g, edge).otherwise(state["edge"]).alias("edge"), g.alias("open")))).otherwise(state)

            return F.aggregate(neighbours, F.struct(start.alias("edge"), F.lit(True).alias("open")), step)["edge"]

        def widened_along(line):
            before = F.reverse(F.slice(items, F.lit(1), i))
            after = F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
            return let(F.struct(walk(line, before, F.lit(0.0), True).alias("low"), walk(line, after, item["width"], False).alias("high")), lambda reach: wide(line, reach))

        def wide(line, reach):
            moved = F.array(a, b, c, d, line["e"] + line["ux"] * reach["low"], line["f"] + line["uy"] * reach["low"])
            return F.struct(item["id"].alias("id"), item["str"].alias("str"), item["text"].alias("text"), moved.alias("transform"), (reach["high"] - reach["low"]).alias("width"))

        grown = ~is_blank(item["text"]) & (F.length(trim(item["text"])) > F.length(trim(item["str"]))) & (along > 0) & (tall > 0)
        line = F.struct((a / along).alias("ux"), (b / along).alias("uy"), e.alias("e"), f.alias("f"), tall.alias("tall"))
        return F.when(grown, let(line, widened_along)).otherwise(F.struct(*[item[k].alias(k) for k in ("id", "str", "text", "transform", "width")]))

    return pages.withColumn(items, F.transform(items, entry))
