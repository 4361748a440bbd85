"""Plain-Python models of the sequential semantics, used only to check the Spark operators."""

from collections import Counter, defaultdict, deque


def cooldown_model(rows, cooldown):
    """rows: (key, t, seq). Returns the rows that fire."""
    last, out = {}, []
    for key, t, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        c = cooldown[key] if isinstance(cooldown, dict) else cooldown
        if c > 0 and key in last and t < last[key] + c:
            continue
        last[key] = t
        out.append((key, t, seq))
    return sorted(out)


def window_model(rows, w):
    """rows: dicts with key, t, seq, path, ip, action. Deque evaluation at every row."""
    dq, out = defaultdict(deque), {}
    for r in sorted(rows, key=lambda r: (r["t"], r["seq"])):
        q = dq[r["key"]]
        q.append(r)
        while q[0]["t"] < r["t"] - w:
            q.popleft()
        tops = Counter(x["ip"] for x in q if x["ip"])
        out[r["seq"]] = (
            len(q),
            sum(x["action"] == "fail" for x in q),
            len({x["path"] for x in q if x["path"]}),
            len({x["ip"] for x in q if x["ip"]}),
            max(tops.values(), default=0),
        )
    return out
