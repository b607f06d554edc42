"""Per-frame tables of driver monitoring: landmarks, boxes, captions and scores as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.windows import top_per_group

EPSILON = 1e-4
#: The four eye points of one eye: left and right corner, upper and lower lid, by place among the 8 points given (fixed values).
RIGHT_EYE, LEFT_EYE = (0, 1, 2, 3), (4, 5, 6, 7)


def points(values: Column) -> Column:
    """x, y pairs from a flat array of numbers."""
    n = F.floor(F.size(values) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(values, i * 2).cast("double").alias("x"), F.get(values, i * 2 + 1).cast("double").alias("y")))


def gap(p: Column, i: int, j: int) -> Column:
    a, b = F.get(p, F.lit(i)), F.get(p, F.lit(j))
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)


def eye_ratio(p: Column) -> Column:
    """Mean over both eyes of width over height."""
    one = lambda e: gap(p, e[0], e[1]) / (gap(p, e[2], e[3]) + EPSILON)
    return (one(RIGHT_EYE) + one(LEFT_EYE)) / 2


def mouth_ratio(p: Column, upper: tuple[int, int], lower: tuple[int, int], corners: tuple[int, int]) -> Column:
    """(height + height) / (2 * width) from point places: two upper-lower pairs and the corners; null where the width is 0."""
    return F.try_divide(gap(p, upper[0], lower[0]) + gap(p, upper[1], lower[1]), 2 * gap(p, *corners))


def scale_points(p: Column, width: int, height: int) -> Column:
    return F.transform(p, lambda s: F.struct(F.floor(s["x"] * width).cast("int").alias("x"), F.floor(s["y"] * height).cast("int").alias("y")))


def yawn_frames(df: DataFrame, ratio: str, name: str, mirror: str = "Mirror", mirror_threshold: float = 0.7, threshold: float = 1.0) -> DataFrame:
    return df.where(F.col(ratio) > F.when(F.col(name).contains(mirror), mirror_threshold).otherwise(threshold))


def box_normalize(df: DataFrame, left: str, top: str, right: str, bottom: str, width: str, height: str) -> DataFrame:
    """Centre and size of a pixel box as fractions of the image."""
    return df.withColumns({"xc": (F.col(left) + F.col(right)) / 2 / F.col(width), "yc": (F.col(top) + F.col(bottom)) / 2 / F.col(height), "w": (F.col(right) - F.col(left)) / F.col(width), "h": (F.col(bottom) - F.col(top)) / F.col(height)})


def single_box_frames(df: DataFrame, frame: Sequence[str], confidence: str, least: float = 0.6) -> DataFrame:
    """Frames with exactly one box that is sure enough, with that box's columns."""
    rest = [c for c in df.columns if c not in frame]
    one = df.where(F.col(confidence) >= least).groupBy(*frame).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in rest])
    return one.where("_n = 1").drop("_n").select(*df.columns)


def label_line(label: Column, *numbers: Column) -> Column:
    """class xc yc w h as text, six decimals."""
    return F.concat_ws(" ", label.cast("string"), *[F.format_string("%.6f", n) for n in numbers])


def eye_class_lines(df: DataFrame, frame: Sequence[str], kind: str, line: str, awake: str = "awake") -> DataFrame:
    """One record of label lines a frame: 0 for an awake eye, else 1, in order of line."""
    each = F.concat_ws(" ", F.when(F.col(kind) == awake, "0").otherwise("1"), F.col(line).cast("string"))
    return df.groupBy(*frame).agg(F.array_join(F.array_sort(F.collect_list(each)), "\n").alias("record"))


def zero_shot_frames(df: DataFrame, frame: Sequence[str], caption: str, score: str, session: str, phone: Sequence[str], drowsy: Sequence[str] | None = None, least: float = 0.85, drowsy_session: str = "s5") -> DataFrame:
    """The best caption of each frame, where it is phone use that is sure enough, or drowsiness in its session. Without `drowsy`, captions that aren't phone use are.

    Of equal scores the first caption by name is best, a null one last.
    """
    best = top_per_group(df, frame, [F.desc(score), F.asc_nulls_last(caption)], 1).drop("rank")
    sleepy = ~F.col(caption).isin(*phone) if drowsy is None else F.col(caption).isin(*drowsy)
    kind = F.when(F.col(caption).isin(*phone) & (F.col(score) > least), "distraction").when(sleepy & (F.col(session) == drowsy_session), "drowsiness")
    return best.withColumn("kind", kind).where("kind is not null")


def detection_labels(df: DataFrame, kind: str, confidence: str, names: dict[int, str]) -> DataFrame:
    """Detections of the named classes, with `name: confidence`, rounded half to even to two decimals at most and written without padding (0.5, 0.12)."""
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(kind)]
    return df.where(F.col(kind).isin(*names)).withColumn("label", F.concat(name, F.lit(": "), F.bround(F.col(confidence), 2).cast("string")))


def video_name_parts(name: Column) -> Column:
    """The third underscore-separated field of a file name, the session type."""
    return F.get(F.split(name, "_"), F.lit(2))
