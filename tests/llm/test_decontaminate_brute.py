"""The rules of decontamination by plain loops over all pairs of documents and items, and recall of questions with other values."""

import random
from collections import Counter, defaultdict
from math import ceil

from tidemark.llm.decontaminate import LITERAL, SIMILARITY, UNITS, WORDS, leaks

NAMES = "Ann Bob Carl Dee Eve Fay Gus Hal Ida Jim Kay Leo Mia Ned Ola Pam".split()
PLAIN = "and then pays keeps gives more less each day old friend with after before both every other left over small green house".split()


def marked(text):
    """(template word, value or None, word) of each word."""
    out, begins = [], True
    for token in text.split():
        word = token.strip(".,!?:;")
        if word:
            low = word.lower()
            kind = "<num>" if word[0].isdigit() else "<name>" if word[0].isupper() and not begins else "<unit>" if low in UNITS else None
            out.append((kind or low, kind and kind + low, low))
            begins = False
        begins = begins or token[-1] in ".!?:"
    return out


def cut(words, width):
    """{key: [(place, values)]} of all windows of this width."""
    found = defaultdict(list)
    for at in range(len(words) - width + 1 if width else 0):
        part = words[at : at + width]
        values = tuple(v for _, v, _ in part if v)
        if len(values) <= max(0, width - LITERAL):
            found["template", *[k for k, _, _ in part]].append((at, values))
        found["words", *[w for _, _, w in part]].append((at, ()))
    return found


def covered(places, words):
    seen = {k for at in places for k in range(at, at + min(WORDS, words))}
    return len(seen) / words


def judged(rows):
    """The places in the item of the windows of one occurrence that agree with its majority."""
    votes = Counter((v, d) for _, _, a, b in rows for v, d in zip(a, b, strict=True))
    best = {}
    for (v, d), n in sorted(votes.items()):
        if v not in best or n > best[v][0]:
            best[v] = (n, d)
    owner = {}
    for v, (n, d) in sorted(best.items()):
        if d not in owner or n > owner[d][0]:
            owner[d] = (n, v)
    return {at for _, at, a, b in rows if all(best[v][1] == d and owner[d][1] == v for v, d in zip(a, b, strict=True))}


def brute(docs, items):
    out = {}
    for doc, text in docs:
        theirs = marked(text)
        for item, item_text in items:
            ours = marked(item_text)
            words, width = len(ours), min(WORDS, len(ours))
            if not words:
                continue
            mine, other = cut(ours, width), cut(theirs, width)
            met = [(pos, at, a, b, key[0]) for key, places in mine.items() for at, a in places for pos, b in other.get(key, [])]
            if covered({m[1] for m in met}, words) < SIMILARITY:
                continue
            reach, groups = ceil(words * (1 - SIMILARITY)), defaultdict(list)
            shifts = {pos - at for pos, at, *_ in met}
            for pos, at, a, b, kind in met:
                groups["same", pos - at].append((pos, at, a, b))
                for s in shifts:
                    if abs(s - (pos - at)) <= reach:
                        groups["around", s].append((pos, at, a, b))
                groups["all", 0].append((pos, at, a, b))
                if kind == "template":
                    groups["templates", 0].append((pos, at, a, b))
            for rows in groups.values():
                good = judged(rows)
                share = covered(good, words)
                if share >= SIMILARITY and len(good) >= SIMILARITY * len({r[1] for r in rows}):
                    out[doc, item] = max(out.get((doc, item), (0, 0)), (round(share, 9), len(good)))
    return out


def question(rng):
    n = rng.choice([3, 8, 12, 20, 30])
    few = rng.sample(NAMES, 3), [str(rng.randint(2, 99)) for _ in range(3)]
    pick = lambda: rng.choices([rng.choice(PLAIN), rng.choice(few[0]), rng.choice(few[1]), rng.choice(["kg", "dollars"])], [6, 2, 2, 1])[0]
    return " ".join(pick() for _ in range(n)) + rng.choice([".", "?", ""])


def other_values(text, rng):
    """The same question with other names and numbers, each value always for the same one."""
    names, numbers = dict(zip(NAMES, rng.sample(NAMES, len(NAMES)), strict=True)), {}
    out, begins = [], True
    for token in text.split():
        word = token.strip(".,!?:;")
        new = names.get(word, word) if not begins else word
        if word.isdigit():
            new = numbers.setdefault(word, str(100 + 7 * len(numbers) + rng.randint(0, 6)))
        out.append(token.replace(word, new) if word else token)
        begins = token[-1] in ".!?:"
    return " ".join(out)


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


def test_equals_the_rules_by_loops(spark):
    rng = random.Random(5)
    items = [(i, question(rng)) for i in range(40)]
    docs = []
    for d in range(200):
        parts = []
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(items)[1]
            text = other_values(text, rng) if rng.random() < 0.6 else text
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(PLAIN + NAMES)]
            parts.append(" ".join(words))
            parts.append(question(rng))
        docs.append((d, rng.choice([". ", "\n", " "]).join(parts)))
    got = {(r.doc_id, r.item_id): (round(r.covered, 9), r.windows) for r in leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()}
    want = brute(docs, items)
    assert len(want) > 100 and got == want


def test_recall_of_questions_with_other_values(spark):
    """At least 0.9 of the questions of 12 words or more with other names and numbers are found, and no document without one is."""
    rng = random.Random(9)
    items = [(i, q) for i, q in enumerate(question(rng) for _ in range(400)) if len(q.split()) >= 12]
    docs = [(i, f"{question(rng)}\n{other_values(q, rng)}\n{question(rng)}") for i, q in items]
    docs += [(10_000 + i, f"{question(rng)}\n{question(rng)}") for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in leaks(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()}
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items)
    assert not [d for d, _ in got if d >= 10_000]
