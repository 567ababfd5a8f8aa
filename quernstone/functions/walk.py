"""Reading order of a program's paragraphs (G2). Pure functions; nothing here knows Spark."""

from __future__ import annotations


def reading_order(paragraphs: list[str], edges: list[tuple[str, str, str, str, int]], limit: int = 10_000_000) -> tuple[list[tuple[int, str, str, int]], list[str]]:
    """([(place, paragraph, how it is reached, depth)], never reached).

    ``edges``: (from, to, thru, kind, line). A PERFORM reads its range and comes back; a GO TO and falling through stay
    where they lead; what lies behind the end of a performed range is not read on its account. A paragraph is read once,
    at its first place. Tasks stand on a stack of their own, so depth has no bound but ``limit``.
    """
    place = {name: k for k, name in reversed(list(enumerate(paragraphs)))}
    out: list[tuple[int, str, str, int]] = []
    seen: set[int] = set()
    leads: dict[str, list[tuple[str, str, str, int]]] = {}
    for source, to, thru, kind, line in edges:
        leads.setdefault(source, []).append((to, thru, kind, line))
    tasks: list[tuple[int, int, str, int]] = [(0, -1, "start", 0)] if paragraphs else []
    while tasks and len(out) < limit:
        k, stop, how, depth = tasks.pop()
        if k in seen:
            continue
        seen.add(k)
        out.append((len(out) + 1, paragraphs[k], how, depth))
        follow = []
        for to, thru, kind, _ in sorted(leads.get(paragraphs[k], ()), key=lambda e: (e[2] == "fallthrough", e[3])):
            if to not in place:
                continue
            if kind == "perform":
                follow.append((place[to], place.get(thru, place[to]), "perform", depth + 1))
            elif kind == "fallthrough":
                if k != stop:
                    follow.append((place[to], stop, "fallthrough", depth))
            else:
                follow.append((place[to], stop, kind, depth))
        tasks.extend(reversed(follow))
    return out, [name for k, name in enumerate(paragraphs) if k not in seen]
