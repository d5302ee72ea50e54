"""Label normalisation expressions (column in, column out; no actions).

All of these are plain Catalyst expressions, so they run inside whole-stage
codegen and work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Fixed values that must match the reference's label vocabulary.
NEGATIVE_LABELS = ("NOT", "not_sarcastic")
EMOTIONS = ("sadness", "joy", "anger", "fear")  # precedence order of the intensity parser


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary_label(c, negatives: Sequence[str] = NEGATIVE_LABELS, numeric: bool = False) -> Column:
    """0 for a negative label, 1 for everything else (NULL and the string '0' included).

    ``numeric=True`` is the overload for numeric label columns: only the number 0
    is negative.
    """
    c = _col(c)
    if numeric:
        return F.when(c == F.lit(0), F.lit(0)).otherwise(F.lit(1)).cast("int")
    return F.when(c.isin(*negatives), F.lit(0)).otherwise(F.lit(1)).cast("int")


def binary_label_for(df, name: str, negatives: Sequence[str] = NEGATIVE_LABELS) -> Column:
    """N1 choosing the overload from the column's type in ``df``."""
    is_num = isinstance(df.schema[name].dataType, NumericType)
    return binary_label(name, negatives, numeric=is_num)


def class_name(ind, task) -> Column:
    """``task`` when the indicator is 1, else ``non_<task>`` (NULL -> non_).

    ``task`` is a literal task name (str) or a Column holding it.
    """
    ind = _col(ind)
    task = F.lit(task) if isinstance(task, str) else task
    return F.when(ind == 1, task).otherwise(F.concat(F.lit("non_"), task))


def intensity_class(c) -> Column:
    """Class name from an intensity string such as ``2: moderate amount of joy``.

    Contains a '0' anywhere -> ``non_<emotion>``; else contains 1/2/3 -> ``<emotion>``;
    the emotion is the first of sadness, joy, anger, fear that occurs; otherwise NULL.
    """
    c = _col(c)

    def pick(prefix: str) -> Column:
        out = None
        for emo in EMOTIONS:
            cond = c.contains(emo)
            val = F.lit(prefix + emo)
            out = F.when(cond, val) if out is None else out.when(cond, val)
        return out

    return (F.when(c.contains("0"), pick("non_"))
            .when(c.contains("1") | c.contains("2") | c.contains("3"), pick("")))


def intensity_parts(c) -> dict[str, Column]:
    """Split ``Intensity Class`` on ':' into indicator text, number and description.

    ``emotion_ind`` is the integer when the first part parses, ``emo_desc`` keeps its
    leading space; ``n_parts`` lets callers count rows the reference could not assign.
    """
    c = _col(c)
    parts = F.split(c, ":")
    first = F.element_at(parts, 1)
    return {
        "ind_text": first,
        "emotion_ind": first.try_cast("int"),
        "emo_desc": F.when(F.size(parts) >= 2, F.element_at(parts, 2)),
        "n_parts": F.size(parts),
    }


def ordinal_or_binary(ind, convert_to_binary: bool) -> Column:
    """Keep the 0..3 ordinal, or apply the numeric N1 overload."""
    ind = _col(ind)
    return binary_label(ind, numeric=True) if convert_to_binary else ind.cast("int")
