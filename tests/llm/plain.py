"""Brute-force models of the llm operators, and documents with awkward cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")


def awkward_documents(spark, seed=5):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    random.seed(seed)
    common = ["the", "of", "and", "to", "in", "a", "is"]
    english = common + ["".join(random.choices("thernadiso", k=random.randint(3, 9))) for _ in range(300)]
    german = ["der", "die", "und", "zu"] + ["".join(random.choices("schüßeung", k=random.randint(3, 9))) for _ in range(300)]
    rows = []
    for k in range(120):
        words = random.choices(english if k % 2 else german, k=random.randint(1, 160))
        rows.append((k, " ".join(words), "en" if k % 2 else "de"))
    base = random.choices(english, k=120)
    for k in range(200, 230):
        edited = [w if random.random() > 0.02 else "edit" + str(k) for w in base]
        rows.append((k, " ".join(edited), "en"))
    rows += [(300, " ".join(base), "en"), (301, " ".join(base).upper(), "en"), (302, " ".join(base), None)]
    rows += [(302, " ".join(base), None)]  # a repeated row
    rows += [(310, None, "en"), (311, "", None), (312, " \n\t ", "de"), (313, "1234 !?", "en"), (314, "x", None)]
    rows += [(315, "one two", "en"), (316, "one two", "en"), (317, "one two three", "en")]
    rows += [(320, "word " * 30000, "en"), (321, "x" * 200000, "en"), (322, "line\n" * 5000, "en")]
    rows += [(330, 'token = "' + "a1B2c3D4" * 4 + '" end of it', "en"), (None, "no id here at all", "en")]
    clashing = "score double, rank int, sid long, n long, word string, part int, kept boolean, row long, call string, stays boolean, a long, side int"
    return spark.createDataFrame(
        [(*r, None, "src", len(r[1] or ""), 0.5, 1, 2, 3, "w", 4, True, 5, "c", False, 6, 7) for r in rows],
        f"doc_id long, text string, lang string, extra string, source string, n_chars long, {clashing}",
    ).repartition(5)


def rows_of(documents):
    return [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def linked_groups(rows, size, num, den):
    """For each row (set size, smallest id reachable, links), by comparing all pairs of sets."""
    sets = [shingles(text, size) for _, text in rows]
    owners: dict = {}
    for k, s in enumerate(sets):
        owners.setdefault(s, []).append(k)
    different = [s for s in owners if s]
    near: dict = {s: [s] for s in different}
    for i, a in enumerate(different):
        for b in different[:i]:
            both = len(a & b)
            if den * both >= num * (len(a) + len(b) - both):
                near[a].append(b)
                near[b].append(a)
    first = {}
    for s in different:
        if s in first:
            continue
        seen, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        ids = [rows[k][0] for t in seen for k in owners[t] if rows[k][0] is not None]
        first.update(dict.fromkeys(seen, min(ids) if ids else None))
    return [
        (rows[k][0], len(s), first[s], sum(len(owners[t]) for t in near[s]) - 1)
        if s else (rows[k][0], 0, rows[k][0], 0)
        for k, s in enumerate(sets)
    ]


def backoff_scores(rows, least=2, backoff=0.4):
    """(words, micro-nats) of each row under the bigram model of all rows."""
    texts = [WORD.findall(text) for _, text in rows]
    single = Counter(w for t in texts for w in t)
    total = sum(single.values())
    heads = Counter(w for t in texts for w in t[:-1])
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    out = []
    for t in texts:
        score = 0
        for k, w in enumerate(t):
            if k and pairs[t[k - 1], w] >= least:
                value = pairs[t[k - 1], w] / heads[t[k - 1]]
            else:
                value = (backoff if k else 1.0) * (single[w] / total)
            score += math.floor(math.log(value) * 1e6 + 0.5)
        out.append((len(t), score))
    return out


def personal_spans(text):
    """Base spans of personal data as the contract words them."""
    spans = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            spans.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd, even = digits[::-2], digits[-2::-2]
        if 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0:
            spans.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", m))
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in spans)


def secret_spans(text):
    """Base spans of secrets as the contract words them."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def quality_counts(text):
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered), len(lines),
    )


def best_rows(vectors, every=100, k=10):
    """(query id, rank, id, score) by scoring all pairs; vectors are (id, list or None)."""
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and fine(v)]
    out = []
    for q, v in whole:
        if q % every == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v)
            )
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)
