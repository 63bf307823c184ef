import numpy as np
import pytest

#: Texts that every operator has to take: null, empty, blank, one word, very long, odd characters, control strings.
ODD = [
    None, "", " \n\t ", "one", "one", "é" * 3 + " Ünïcode ΑΣ ½ 日本 🙂", "long " * 40_000, "x" * 100_000, "<|im_start|>\\<\\|[INST]</s>", "a\x00b \x85 c d",
    "mail a@b.co or +1 (415) 555-0000", "The cat sat on the mat and the dog lay by the door of the old house today",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with null and repeated ids, a repeated row, and columns whose names clash with those the operators use."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", i) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id here at all", "fr", None, None), (None, None, None, None, None), (3, "same id, another text", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("k1", "tid", "size", "score", "shard", "term", "word", "pos", "base", "spans")})


@pytest.fixture(scope="session")
def prose(spark):
    """Random texts with copies, near copies, repeated lines and benchmark passages."""
    rng = np.random.default_rng(4)
    words = np.array(["".join(rng.choice(list("abcdeghilmnorstu"), rng.integers(2, 8))) for _ in range(900)])
    texts = [" ".join(rng.choice(words, rng.integers(30, 160))) for _ in range(120)]
    for i in range(0, 30):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[5] + "\n" + texts[6], "\n".join([texts[7]] * 3)]
    rows = [(i, t, ["en", "fr"][i % 2], "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
