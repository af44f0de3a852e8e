"""Small invented corpora for the tests."""

import random

SYLLABLES = {"aa": "th er on an re he in ed nd ha at en es of or".split(), "bb": "sch ung ein ich der die und zu ver ge keit ach tz pf au".split(), "cc": "ción ado os que ar es la men te rr ll ja bo ñ mi".split()}
BAD = ["idiot", "scum", "moron", "trash", "loser", "clown"]


def words(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]


def documents(seed=0, n=600):
    """(doc_id, text, lang, source, n_chars), and the toxic ids."""
    rng = random.Random(seed)
    rows, toxic = [], set()
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = words(rng, lang, rng.randint(30, 120))
        if i % 6 == 0:
            toxic.add(i)
            for bad in rng.sample(BAD, 3):
                text.insert(rng.randrange(len(text)), bad + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(text), lang, f"src{rng.randrange(9)}", 0))
    return rows, toxic
