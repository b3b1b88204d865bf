"""Plain single-machine versions of the operators' contracts."""

import hashlib
import re

import xxhash

SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
PERSONAL = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in t.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t: 14 <= len(d := re.sub(r"[^0-9]", "", t)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 10 <= len(re.sub(r"[^0-9]", "", t)) <= 15),
]


def luhn(digits):
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def secrets(text):
    return joined((m.start(), r, m.end(), kind) for r, (kind, pattern, group, least) in enumerate(SECRETS)
                  for m in pattern.finditer(text or "") if len(m[group]) >= least)


def personal(text):
    return joined((m.start(), r, m.end(), kind) for r, (kind, pattern, ok) in enumerate(PERSONAL)
                  for m in pattern.finditer(text or "") if ok(m[0]))


def digest(spans):
    return hashlib.sha256(spans.encode()).hexdigest()


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Smallest id reachable from each (id, fingerprint)."""
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                ids[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(prints))]


def least_edits(item, text):
    """Fewest edits from ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)
