"""Small tables with every awkward case, and plain statements of what the operators return."""

import zlib

WHITE = " \t\n\x0b\x0c\r"

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank"
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE.upper(), "en", "b"),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \t\n\x0b ", "de", "b"),
    (7, "one", "en", "a"),
    (8, "Header\nbody of eight\nHEADER \n\nfooter", "en", "a"),
    (8, "Header\nbody of eight\nHEADER \n\nfooter", "en", "a"),
    (8, "Header\nanother body\nfooter", "en", "a"),
    (None, "header\nno id here\n footer", "en", "a"),
    (9, "header\nnine\n" + PROSE, "fr", "c"),
    (10, "ÄÖÜ straße été x \U0001f600 header\nheader", "de", "c"),
    (11, ("word%d " * 700) % tuple(range(700)) + "end", "en", "a"),
    (12, "a b c d e a b c d e a b c\nx\nx\nx", "en", "a"),
    (13, "<|endoftext|> it's 2024 ... don't", "en", "a"),
]


def documents(spark, rows=ROWS, **more):
    """A table with the columns of `documents` and further ones of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(3)


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def key(row):
    """A sort key that takes nulls."""
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in row)


def same(a, b):
    return sorted(a, key=key) == sorted(b, key=key)
