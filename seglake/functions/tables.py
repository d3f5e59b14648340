"""Table functions for SQL: ``register(spark)``, then ``SELECT ... FROM pairs p, LATERAL align_words(p.r, p.h)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

OPERATIONS = "op_no bigint, op string, ref_idx bigint, hyp_idx bigint, ref_pos bigint, hyp_pos bigint, ref_word string, hyp_word string"


class AlignWords:
    """One row per edit operation between two word arrays; null arrays have no words."""

    def eval(self, ref: list[str], hyp: list[str]) -> Iterator[tuple]:
        from ..operators.scoring import DEL, INS, NAMES, edit_path, numbered

        r, h = list(ref if ref is not None else ()), list(hyp if hyp is not None else ())
        i = j = 0
        for no, op in enumerate(edit_path(*numbered(r, h)).tolist()):
            here, there = op != INS, op != DEL
            row = (i if here else None, j if there else None, i + here, j + there, r[i] if here else None, h[j] if there else None)
            i, j = i + here, j + there
            yield (no, str(NAMES[op]), *row)


def register(spark: SparkSession) -> None:
    spark.udtf.register("align_words", F.udtf(AlignWords, returnType=OPERATIONS, useArrow=True))
