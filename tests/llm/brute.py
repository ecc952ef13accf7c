"""Plain Python versions of the operators' rules, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = "\x20\t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def rule_counts(text):
    text = text or ""
    found = words(text)
    grams = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(found)
    return {"n_words": n, "word_chars": sum(map(len, found)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def exact_groups(rows):
    """(id, text) rows to id -> (keep_id, size, sha) by normalised text; ids are distinct."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    return {key: (min(ids), len(ids), hashlib.sha256(norm.encode()).hexdigest())
            for norm, ids in groups.items() for key in ids}


def simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = words(low)
    if not found:
        return 0
    parts = ([" ".join(found)] if len(found) < 4
             else [" ".join(found[i:i + 4]) for i in range(len(found) - 3)])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, reach=4):
    """id -> smallest id reachable by links of at most ``reach`` bits."""
    distinct = sorted(set(prints.values()))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= reach:
                root[find(b)] = find(a)
    least = {}
    for key, p in prints.items():
        least[find(p)] = min(key, least.get(find(p), key))
    return {key: least[find(p)] for key, p in prints.items()}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def secret_base(text):
    """(start, rank, end, kind) of the base rules, by start then kind."""
    text = text or ""
    out = []
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k)
                       for k in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"({keyword})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def pii_base(text):
    """(start, rank, end, kind) of the base rules, by kind then start."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in
            re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out, key=lambda s: (s[1], s[0]))


def listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
