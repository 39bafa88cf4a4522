"""Plain versions of the contracts, a row at a time, to test the operators against."""

import hashlib
import re

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def spans(text, patterns):
    possible = [(kind, p, ok) for kind, (p, ok) in patterns.items() if {"email": "@", "ip": "."}.get(kind, "") in (text or "")]  # else it tries from every place to the end
    return [(kind, m.start(), m.end()) for kind, p, ok in possible for m in re.finditer(p, text or "") if ok(m)]


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def pii(text):
    found = spans(text, PII)
    return [sum(k == kind for k, _, _ in found) for kind in PII], hashlib.sha256(joined(found).encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in found}


def secrets(text):
    kinds = list(SECRETS)
    found = sorted(spans(text, SECRETS), key=lambda s: (s[1], kinds.index(s[0])))
    return [sum(k == kind for k, _, _ in found) for kind in kinds], hashlib.sha256(joined(found).encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in found}


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + o for i in at for o in range(3))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()
