import random
import re
from collections import Counter

from attestra.llm import quality


def brute_repeat(words):
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if found[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_base_measures_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "a ", "c\n", "#", "\x1c", "é ", "\t", "|", "　"]) for _ in range(rng.randint(0, 120)))
        n, chars, symbols, dup, repeat, failed, _, _, _ = quality.judge(text)
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert n == len(words) and chars == sum(map(len, words))
        assert symbols == sum(c in "#*$%&|<>" for c in text)
        assert dup == len(lines) - len(set(lines))
        assert repeat == brute_repeat(words)
        assert failed == (n < 20 or 100 * repeat > 30 * n)


def test_lines_and_verdict():
    prose = "\n".join(
        [
            "The quick brown foxes jumped over a lazy dog near the river bank.",
            "Nobody in the village had seen so much rain since the mill burned down.",
            "She kept three ledgers, and only one of them was ever shown to the bank.",
            "Would it matter to anyone whether the gate was left open overnight?",
        ]
    )
    assert quality.judge(prose)[7]
    menu = "\n".join("Home | About | Contact | Help for everybody who is lost here" for _ in range(9))
    assert not quality.judge(prose[:140] + ".\n" + menu)[7]
    mixed = quality.judge(prose + "\nAccept all cookies\nThis work is licensed freely.")
    assert mixed[7] and mixed[8] == prose
    assert quality.judge(None)[5] and quality.judge("")[8] == ""


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (3, "w " * 50_000, 0)], "doc_id long, text string, n_words int")
    out = quality.clean_lines(df).collect()
    assert [r.n_words for r in out] == [0, 0, 0, 50_000] and not any(r.kept for r in out)
    assert quality.clean_lines(df.limit(0)).count() == 0
