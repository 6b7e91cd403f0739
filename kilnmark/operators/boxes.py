"""Text boxes of one image: joining pieces of a row, and choosing among overlapping boxes."""

from __future__ import annotations

from itertools import filterfalse, groupby, islice, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType


def merge_lines(boxes: DataFrame, key: str = "doc_id", tolerance: float = 0.6, gap: float = 2.0) -> DataFrame:
    """(key, line): texts of neighbour boxes in a row, joined; columns text, cy, h, x0, x1.

    Rows are seeded one after the other from the top, so the order matters: boxes are dealt by image and sorted, and one pass
    over Arrow batches puts each into the first row that takes it, or makes it the seed of a new one. Boxes lower than 1 or
    without a place are left out, islands of one box give nothing, a null text is empty."""

    def islands(row):
        """Of one row, from left to right: the runs without a wide gap."""
        row = sorted(row, key=lambda b: b[3])
        island = row[:1]
        for left, right in pairwise(row):
            if right[3] - left[4] > gap * max(left[2], right[2]):
                yield island
                island = []
            island.append(right)
        yield island

    def rows_of(image):
        rows = []  # those that a box further down may still join
        for box in image:
            cy, h = box[1], box[2]
            # a box of twice a seed's height is the highest that it takes; a little more, as products are rounded
            past = lambda row: cy - row[0][1] > 2.001 * tolerance * row[0][2]  # noqa: B023, E731
            for row in rows:
                if abs(cy - row[0][1]) <= tolerance * max(row[0][2], h) and 0.5 <= h / row[0][2] <= 2:
                    row.append(box)
                    break
            else:
                done, rows = [*filter(past, rows)], [*filterfalse(past, rows), [box]]
                yield from done
        yield from rows

    def run(batches):
        sorted_boxes = (box for x in batches for box in zip(*(c.to_pylist() for c in x.columns), strict=True))
        found = ((k, "".join(b[5] for b in x)) for k, image in groupby(sorted_boxes, itemgetter(0)) for row in rows_of(image) for x in islands(row) if len(x) > 1)
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], kind), pa.array([line for _, line in part], pa.string())], [key, "line"])

    number = lambda c: F.col(c).cast("double").alias(c)
    placed = boxes.select(key, *map(number, ("cy", "h", "x0", "x1")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropna(subset=["cy", "h", "x0", "x1"]).filter("h >= 1")
    dealt = placed.repartition(key).sortWithinPartitions(key, "cy", "x0", "text", "h", "x1")
    schema = StructType([StructField(key, boxes.schema[key].dataType), StructField("line", StringType())])
    kind = to_arrow_type(schema[key].dataType)
    return dealt.mapInArrow(run, schema)


def iou(a: Column, b: Column) -> Column:
    """Of structs x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return w * h / (area(a) + area(b) - w * h)


def non_maximum(boxes: Column, kind: str, limit: float = 0.45) -> Column:
    """Greedy suppression over an array of structs (score, x0, y0, x1, y1), the best first: a native fold."""
    ranked = F.reverse(F.array_sort(boxes))
    return F.aggregate(ranked, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: iou(k, x) > limit), kept).otherwise(F.concat(kept, F.array(x))))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1"))
