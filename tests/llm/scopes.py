"""What credential linking finds in one text, by its rules: parts by pattern, and the scope rule."""
import hashlib
import re

from hopline.llm import credentials as C

KIND = {k: i for i, k in enumerate(C.KINDS)}
IDENT, HIDDEN = {KIND["access"], KIND["id"]}, {KIND["assign"], KIND["hex"], KIND["secret"]}
TOKEN = re.compile("[A-Za-z0-9+/_-]{24,}")


def parts_of(text):
    """(start, kind, end) of every part. The pattern of weak secrets looks ahead from each place; here classes are tested on whole runs."""
    parts = [(m.start(), KIND[kind], m.end()) for kind, (pattern, group, least) in (C.STRONG | C.WEAK).items() if kind != "secret"
             for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return parts + [(m.start(), KIND["secret"], m.end()) for m in TOKEN.finditer(text)
                    if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]


def linked(parts, reach=C.REACH):
    """The parts that are reported: scopes reach from ``reach`` before a part's start to ``reach`` after its end."""
    out = []
    for s, k, e in parts:
        near = {q for a, q, b in parts if a <= e + reach and b >= s - reach}
        covered = any(q < len(C.STRONG) and a <= s < b for a, q, b in parts)
        ident, hidden = near & IDENT, near & HIDDEN
        if k < len(C.STRONG) or not covered and {"id": hidden, "secret": ident, "endpoint": ident and hidden}[C.KINDS[k]]:
            out.append((s, k, e))
    return out


def written(spans):
    return ",".join(f"{C.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def spans(text):
    return written(linked(parts_of(text or "")))


def digests(text):
    """The columns of the query after the id."""
    strong = [p for p in parts_of(text or "") if p[1] < len(C.STRONG)]
    counts = [sum(p[1] == i for p in strong) for i in range(len(C.STRONG))]
    return (*counts, hashlib.sha256(written(strong).encode()).hexdigest(), spans(text))


def redacted(text):
    done, at = "", 0
    for kind, start, end in (s.split(":") for s in spans(text).split(",") if s):
        if int(start) >= at:
            done += text[at:int(start)] + f"<{kind}>"
        at = max(at, int(end))
    return None if text is None else done + text[at:]
