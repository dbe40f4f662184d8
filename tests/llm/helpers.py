"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(value):
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def groups_by_jaccard(docs, width, percent):
    """{id: smallest id reachable} for [(id, text)]."""
    sets = {}
    for d, x in docs:
        w = words(lowered(x))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def removed_words(docs, width):
    """{id: (n_words, removed word numbers, words)}."""
    first = {}
    split = {d: words(x) for d, x in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][i : i + width]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), gone, w)
    return out


def edits(item, text):
    """Least edits of the whole item against any stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def plain_words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def statistics(text):
    x = text or ""
    w = words(x)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in x.split("\n") if words(line)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
