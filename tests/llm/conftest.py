import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, ties,
    repeated rows, control strings, and extra columns with clashing names."""
    words = "the of and to in is that for it as with was on be".split()
    base = " ".join(words[i * i % 14] + str(i % 7) for i in range(120)) + "."
    near = base.replace("the0", "the0", 1) + " tail"
    passage = " ".join(f"pass{i}" for i in range(60))
    long = " ".join(f"w{(i * i * 31 + i) % 99991}" for i in range(30_000))
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, near, None, "b"), (3, None, "en", None),
        (4, "", "fr", "b"), (5, "x", None, "c"), (6, " \t\n ", "en", "a"),
        (7, f"start one two {passage} end", "en", "c"), (8, f"other words {passage}", "de", "c"),
        (9, long, "en", "a"), (10, "Écrivez à Mme Durand: jean.dupont@mail.example.com!", "fr", "b"),
        (10, "Écrivez à Mme Durand: jean.dupont@mail.example.com!", "fr", "b"),
        (None, "no id at all here, said Mr Smith", None, None), (12, "<|endoftext|> </s>[INST] \\ x", "en", "d"),
        (13, "12 34 !!! ***", "en", "d"), (14, "日本語 テキスト 🎉 ½ Ⅷ", None, "e"), (15, "a b", "en", "e"), (16, "A B", "en", "e"),
    ]
    extra = [(i, t, la, s, len(t) if t is not None else None, "r", [1], "d", "e", 1, 2, "k", 0.5, "_", "t")
             for i, t, la, s in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, row string, ids array<int>, "
               "decoded string, entities string, part int, chunk int, known string, score double, found string, token string")


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.where("false")


def words_of(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


@pytest.fixture(scope="session")
def small_docs(spark):
    from conftest import SF_SMALL
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")
