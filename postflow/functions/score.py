"""From sentiment labels to a number."""

from pyspark.sql import Column, functions as F

# What a label counts, and the characters trimmed around it.
LABEL_VALUES = {"pos": 1, "neg": -1}
TRIMMED = "".join(map(chr, range(0x21)))


def sentiment_score(labels: Column) -> Column:
    """Sum over all comma-separated labels in an array: pos is 1, neg is -1, others are 0.

    One bracket on either side of a label is ignored, null elements are too; a null array
    has a null score.
    """
    pieces = F.flatten(
        F.transform(F.filter(labels, lambda s: s.isNotNull()), lambda s: F.split(s, ","))
    )

    def value(piece: Column) -> Column:
        label = F.trim(piece, F.lit(TRIMMED))
        counted = F.lit(0)
        for name, number in LABEL_VALUES.items():
            spellings = [name, f"[{name}", f"{name}]", f"[{name}]"]
            counted = F.when(label.isin(spellings), number).otherwise(counted)
        return counted

    return F.aggregate(pieces, F.lit(0), lambda total, piece: total + value(piece))
