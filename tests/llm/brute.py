"""Plain versions of the operators, word by word and pair by pair, for small tables."""

from __future__ import annotations

import hashlib
import re

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(_LOWER)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def grouped(ids: list[int], linked) -> dict[int, int]:
    """The least id that each reaches by links."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if least[j] < least[i] and linked(i, j):
                    least[i], changed = least[j], True
    return least


def jaccard_groups(rows: dict[int, str | None], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in rows.items()}

    def linked(i: int, j: int) -> bool:
        both = len(sets[i] & sets[j])
        return bool(both) and den * both >= num * (len(sets[i]) + len(sets[j]) - both)

    least = grouped(list(rows), linked)
    return {i: (len(sets[i]), least[i]) for i in rows}


def base_secrets(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, name, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                found.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
    return sorted(found)


def secrets_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(x[2] for x in base_secrets(text)).encode()).hexdigest()


def phrases(text: str | None, known: list[tuple[str, str]]) -> list[tuple[int, str]]:
    w = alnum(text)
    return sorted((i, label) for phrase, label in known for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)


def leaks(docs: dict[int, str | None], items: dict[int, str | None], k: int = 5, share: float = 0.8) -> set[tuple[int, int]]:
    """Documents that hold at least a share of an item's shingles."""
    out = set()
    for j, item in items.items():
        w = alnum(item)
        if not w:
            continue
        n = min(k, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, text in docs.items():
            v = alnum(text)
            if len(own & {tuple(v[x : x + n]) for x in range(len(v) - n + 1)}) >= share * len(own) - 1e-9:
                out.add((i, j))
    return out
