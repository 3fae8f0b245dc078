"""Data that the operators' tests share."""

DOCS = "doc_id long, text string"
#: Columns whose names the operators use themselves.
CLASHING = ", score double, lang string, fp long, fingerprint string, part int, size long, key long, n_tokens long, tie long"


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "xx", 1, "f", 1, 1, 1, 1, 1) for r in rows], DOCS + CLASHING)


def none(spark):
    return spark.createDataFrame([], DOCS)
