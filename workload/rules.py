"""Our currency rules for the attributes of the given tables."""

from __future__ import annotations

from tidemark import RuleBook


def steps(size: int) -> list[tuple[str, str]]:
    """A large partial order: k is older than k+3 and k+7."""
    return [(str(k), str(k + d)) for k in range(size) for d in (3, 7) if k + d < size]


# Older value -> newer value.
SMALL = {
    "event_type": [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error")],
    "o_orderstatus": [("O", "P"), ("P", "F")],
    "o_orderpriority": [
        ("5-LOW", "4-NOT SPECIFIED"),
        ("4-NOT SPECIFIED", "3-MEDIUM"),
        ("3-MEDIUM", "2-HIGH"),
        ("3-MEDIUM", "1-URGENT"),
    ],
    "l_returnflag": [("N", "A"), ("N", "R")],
    "l_linestatus": [("O", "F")],
    "role": [("system", "user"), ("user", "assistant")],
    # rules that leave values out
    "gap_status": [("O", "F")],
    "gap_priority": [("5-LOW", "3-MEDIUM"), ("3-MEDIUM", "1-URGENT")],
    "week": [("w0", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "w4")],
}
SIZES = {"qty50": 50, "props100": 100}

RULES = RuleBook({**SMALL, **{a: steps(n) for a, n in SIZES.items()}})
