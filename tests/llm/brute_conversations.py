"""Plain conversation repair: damage as stated, then the least edits over all (cost, audit) by exhaustive steps."""

import hashlib
import re
import zlib

_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """Rows (conv, turn, role, text) of all conversations, damaged; in any order."""
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(_WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def least(rows, found):
    """Least (cost, audit, repaired lines), by keeping every best way to each (rows used, last initial, begun)."""
    ways = {"": (0, "", ())}  # the initials so far matter only by what may follow: "", "s", "u", "a"
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(table, key, way):
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way

    def inserted(table):
        for _ in range(3):
            for last, (cost, audit, lines) in list(table.items()):
                role = "assistant" if last == "u" else "user"
                better(table, role[0], (cost + 5, audit + "I", (*lines, role + ":")))
        return table

    for (_, role, text), fault in zip(rows, found):
        ways, new = inserted(ways), {}
        for last, (cost, audit, lines) in ways.items():
            better(new, last, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if role[:1] and role[:1] in follow[last]:
                better(new, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            other = "assistant" if last == "u" else "user"
            better(new, other[0], (cost + 1 + more, audit + "R", (*lines, f"{other}:{text}")))
        ways = new
    return min(way for last, way in inserted(ways).items() if last in ("", "a"))


def repair_all(originals, rows):
    """{conv: result tuple} for all original ids."""
    out = {}
    for conv in {r[0] for r in originals}:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[1][:1] for r in own]
        cost, audit, lines = least(own, found)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"),
                     found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
