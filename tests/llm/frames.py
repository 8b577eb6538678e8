"""Small tables of documents."""

#: Columns whose names the operators use themselves; none of them may change a result.
CLASHING = ("n_words", "n_chars", "hashes", "places", "key", "a", "b", "tree", "bucket", "token",
            "known", "row", "id", "component", "label", "held_out", "sequence_id", "_text")


def frame(spark, rows, extra=False):
    """Documents (doc_id, text), with clashing columns if asked for."""
    names = CLASHING if extra else ()
    schema = "doc_id long, text string" + "".join(f", {name} string" for name in names)
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], schema)
