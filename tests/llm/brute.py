"""Plain definitions of the query contracts, one document at a time or all pairs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def simhash(text):
    import xxhash
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, radius=2):
    """Smallest id reachable, per position (all pairs)."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def kept_words(docs, size=20):
    """docs: sorted (id, text). Per document: (n_words, n_removed, sha of the kept words)."""
    seen, out = set(), {}
    for d, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            g = tuple(w[i:i + size])
            if g in seen:
                gone[i:i + size] = [True] * size
            seen.add(g)
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, r in zip(w, gone) if not r)))
    return out


def luhn(d):
    return sum((int(c) * (1 + i % 2) - 1) % 9 + 1 if c != "0" else 0 for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    """[(kind, start, end)] of the base kinds."""
    t, out = text or "", []
    for m in [] if "@" not in t else re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def secrets(text):
    """[(kind, start, end)] of the base kinds."""
    t, out = text or "", []
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k)
                   for k in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m.group(2)) >= 6:
            out.append(("assign", m.start(), m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m.group()) >= 20:
            out.append(("access", m.start(), m.end()))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m.group()) >= 24:
            out.append(("hex", m.start(), m.end()))
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t, w = text or "", words(text)
    lines, seen, dup = [x for x in t.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def tool_calls(turns):
    """Rows of op6 by definition: (conv_id, call_id or '', turn, depth, status, valid, record)."""
    import json

    def dump(x):
        return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    calls, results, out = {}, {}, []
    for c, n, role, text in turns:
        if role == "assistant":
            k = (n + c) % 3
            body = text or ""
            args = [{"query": body, "limit": len(body) % 60}, {"url": f"doc:{c}", "depth": n, "text": body},
                    {"text": body, "unique": len(body) % 2 == 0}][k]
            bad = [body == "" or not 1 <= len(body) % 60 <= 50, not 0 <= n <= 5, body == ""][k]
            calls[c, f"call-{c}-{n}"] = (n, ["search", "fetch", "count_words"][k], args, f"call-{c}-{n - 2}" if n >= 2 else None, not bad)
        elif role == "user" and n > 0:
            results[c, f"call-{c}-{n - 1}"] = (n, text)
        else:
            out.append((c, "", n, None, "message", None, dump({"role": role, "text": text, "turn": n})))
    for (c, i), (n, name, args, after, valid) in calls.items():
        depth, at = 0, after
        while (c, at) in calls:
            depth, at = depth + 1, calls[c, at][3]
        answer = results.get((c, i))
        out.append((c, i, n, depth, "linked" if answer else "unanswered", valid,
                    dump({"id": i, "after": after, "name": name, "arguments": args, "result": answer and answer[1]})))
    for (c, i), (n, text) in results.items():
        if (c, i) not in calls:
            out.append((c, i, n, None, "orphan", None, dump({"id": i, "after": None, "name": None, "arguments": None, "result": text})))
    return out
