"""Small documents with the awkward cases every operator has to take."""
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use themselves
                     T.StructField("size", T.StringType()), T.StructField("shard", T.StringType()),
                     T.StructField("fingerprint", T.StringType()), T.StructField("kept", T.StringType())])

LONG = " ".join(f"word{i % 977} and{i % 31} more{i}" for i in range(9000))


def rows():
    texts = [None, "", "   \n\t ", "one", "two words", "three short words", "A b\x0bc d\x0ce f\r\ng h",
             "the quick brown fox jumps over the lazy dog " * 3, "line one\nline two\nline one\n\n \nline one",
             "Ünï cödé ẞ ı 文字 テキスト  nbsp em", "*** $$$ || <b> & %", LONG, LONG + " tail", "same text here",
             "same text here", "same text here"]
    out = [(i, t, ["en", None, "de"][i % 3], [None, "a", "b", "c"][i % 4], None if t is None else len(t), "x", "y", "z",
            "k") for i, t in enumerate(texts)]
    out += [out[7], out[7], (None, "null id text", None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None), (-5, "negative id", "en", "a", 11, "", "", "", "")]
    return out


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
