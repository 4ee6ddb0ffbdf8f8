"""Training cases beside the base patterns: their entities written otherwise, and decoys in their place.

Labels come from the base patterns; an entity of an island is rewritten so that no base
pattern finds it, and keeps its label, or gives way to a date, a version, an amount or
the like, and loses it. Both stand in the same surroundings, so only the span's own form
can tell them apart.
"""

from __future__ import annotations

import random
import re
import zlib

#: How '@' and '.' of an address are written out, pairwise.
WRITTEN_OUT = ((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" AT ", " DOT "), (" at ", "."))
#: What stands between the parts of an ip address and the groups of a card number.
IP_DOTS = (" . ", "[.]", "(.)", " dot ", " [dot] ")
CARD_GAPS = (".", "/", "_", "  ", " - ", " / ")
#: Forms of telephone numbers without a plus; d: the digits after the country's.
PHONES = ("{c} ({a}) {b}-{e}", "00{c} ({a}) {b}-{e}", "({a}) {b}-{e}", "{a}-{b}-{e}", "{a}.{b}.{e}", "{a} {b} {e}", "{c}-{a}-{b}-{e}", "00{c} {a} {b} {e}", "{a}/{b}-{e}")
#: Forms that are no entity; '#' stands for a digit.
DECOYS = (
    "20##-##-##", "##.##.20##", "##/##/20##", "##:##", "##:##:##", "20##-##-##T##:##", "version #.#.#", "v#.##.#", "#.#.#.#", "page ## of ###",
    "#,###,###.##", "#.###.###,##", "19##-20##", "ISBN 978-#-##-######-#", "section #.#.#", "$###.##", "##%", "no. ####", "#####-####",
    "polka dot", "the dot product", "at # dot #", "meet at ##.##", "look at table.", "@ ##", "####/####", "## - ## - ##", "### x ### x ###", "#####", "################", "# dot # percent",
)


def written_otherwise(kind: int, entity: str, rng: random.Random) -> str | None:
    """The entity (kind: email, ip, card, phone) in another form."""
    if kind == 0:
        at, dot = rng.choice(WRITTEN_OUT)
        local, _, domain = entity.rpartition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return entity.replace(".", rng.choice(IP_DOTS))
    digits = re.sub("[^0-9]", "", entity)
    if kind == 2:
        return rng.choice(CARD_GAPS).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if len(digits) < 10:
        return None
    return rng.choice(PHONES).format(c=digits[:-10], a=digits[-10:-7], b=digits[-7:-4], e=digits[-4:]).strip(" -")


def decoy(rng: random.Random) -> str:
    return re.sub("#", lambda _: rng.choice("0123456789"), rng.choice(DECOYS))


def replaced(text: str, spans: list[tuple[int, int, int]], at: int, new: str, stays: bool) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with span number ``at`` replaced, and its spans."""
    a, kind, b = spans[at]
    move = len(new) - (b - a)
    out = [(x + move * (x >= b), k, y + move * (x >= b)) for n, (x, k, y) in enumerate(spans) if n != at and (y <= a or x >= b)]
    return text[:a] + new + text[b:], sorted(out + [(a, kind, a + len(new))] * stays)


def variants(text: str, spans: list[tuple[int, int, int]], times: int, found) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of ``times`` rewritten and ``times`` decoyed forms; ``found`` gives the base spans of a text.

    The choice depends on the text alone. Forms in which a base pattern finds something at the place are left out.
    """
    rng, out = random.Random(zlib.crc32(text.encode())), []
    for n in range(2 * times if spans else 0):
        at = rng.randrange(len(spans))
        a, kind, b = spans[at]
        new = written_otherwise(kind, text[a:b], rng) if n % 2 else decoy(rng)
        if new:
            made = replaced(text, spans, at, new, bool(n % 2))
            if not any(x < a + len(new) and a < y for x, _, y in found(made[0])):
                out.append(made)
    return out
