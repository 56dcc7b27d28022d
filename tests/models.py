"""Small plain-Python restatements used as test oracles."""

import random
from collections import Counter

SHARP = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
BARS = {"barline", "barline-double", "barline-final", "barline-end-repeat"}


def sharp(p):
    return SHARP.get(p[:-1], p[:-1]) + p[-1]


def ticks(text):
    parts = text.split("/")
    if len(parts) == 2 and all(x.isdigit() for x in parts) and int(parts[1]):
        return 96 * int(parts[0]) // int(parts[1])
    return 24


def notes(tokens, leaky=False):
    """Three passes: raw events with their surroundings, then ties, then marks and beats."""
    raw, staff, measure, run, triplet, armed = [], "treble", 0, 0, False, False
    open_event, marks = None, 0
    ends = []
    for t in tokens:
        head, _, rest = t.partition("-")
        closes = head == "rest" or head == "barline" or t == "staff-bass" or t.startswith("tuplet-3-")
        if closes:
            run += 1
            if open_event is not None:
                armed = False
            open_event = None
        if head in ("note", "rest"):
            e = dict(staff=staff, measure=measure, run=run, triplet=triplet, marks=marks, tie=False,
                     rest=head == "rest", pitch="" if head == "rest" else sharp(rest),
                     ticks=ticks(rest) if head == "rest" else 24, chord=[], dyn=None, armed=False)
            raw.append(e)
            if head == "note":
                e["armed"] = leaky and armed and open_event is None
                armed = False if open_event is not None else armed
                open_event = e
        elif open_event is not None:
            if head == "dur":
                open_event["ticks"] = ticks(rest)
            elif head == "chord":
                open_event["chord"].append(sharp(rest))
            elif head == "dynamic":
                open_event["dyn"] = rest
            elif t == "tie":
                open_event["tie"] = True
        elif t == "tie":
            armed = True
        if t == "staff-bass":
            staff = "bass"
        elif t.startswith("tuplet-3-"):
            triplet = t == "tuplet-3-start"
        elif t == "barline-start-repeat":
            marks += 1
        elif t in BARS:
            if t == "barline-end-repeat":
                ends.append((len(raw), staff))
            measure, staff = measure + 1, "treble"
    merged, prev = [], None
    for i, e in enumerate(raw):
        if (prev is not None and not e["rest"] and not prev["rest"] and prev["run"] == e["run"]
                and prev["pitch"] == e["pitch"] and (prev["tie"] or prev["armed"])):
            c = merged[-1]
            c["ticks"] += e["ticks"]
            c["chord"], c["dyn"] = e["chord"], e["dyn"] or c["dyn"]
        else:
            merged.append(dict(e, at=i))
        prev = e
    out, seen_marks, beat = [], 0, {}
    for c in merged:
        n = c["ticks"] * 2 // 3 if c["triplet"] else c["ticks"]
        place = (c["staff"], c["measure"])
        out.append(dict(staff=c["staff"], measure=c["measure"], pitch=c["pitch"], ticks=n,
                        beat=beat.get(place, 0) % 4 + 1, chord=c["chord"], rest=c["rest"],
                        dyn=c["dyn"], tuplet=c["triplet"], at=c["at"],
                        repeat="start-repeat" if c["marks"] > seen_marks else None))
        seen_marks = c["marks"]
        beat[place] = beat.get(place, 0) + min(4, max(1, round(n / 24)))
    for count, staff in ends:
        before = [o for o in out if o["staff"] == staff and o["at"] < count]
        if before:
            before[-1]["repeat"] = "end-repeat"
    return out


def matched_spans(tokens):
    """Index set of span tokens that have a partner."""
    keep, stacks = set(), {}
    for i, t in enumerate(tokens):
        kind, _, end = t.rpartition("-")
        if end == "start" and kind in SPANS:
            stacks.setdefault(kind, []).append(i)
        elif end == "end" and stacks.get(kind):
            keep |= {i, stacks[kind].pop()}
    return keep


SPANS = ("slur", "hairpin-cresc", "hairpin-dim", "ottava-8va", "ottava-8vb", "tuplet-3")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def line_breaks(weights, cap):
    out, total = [], 0.0
    for i, w in enumerate(weights):
        if i and total + w > cap:
            out.append(i)
            total = 0.0
        total += w
    return out


def vote(lengths):
    return Counter(lengths).most_common(1)[0][0] if lengths else None


POOL = (["note-C4", "note-Db4", "note-C#4", "note-D4"] * 4 + ["dur-1/4", "dur-1/8", "dur-1/2", "dur-x",
        "tie", "tie", "tie", "rest-1/4", "rest-1/8", "chord-E4", "chord-Gb4", "dynamic-p", "dynamic-f",
        "staff-bass", "barline", "barline", "barline-double", "barline-start-repeat",
        "barline-end-repeat", "barline-final", "tuplet-3-start", "tuplet-3-end", "slur-start",
        "slur-end", "slur-end", "hairpin-cresc-start", "hairpin-cresc-end", "clef-F", "clef-G",
        "key-Eb", "time-3/4", "fermata"])


def random_scores(n, seed, longest=70):
    r = random.Random(seed)
    return {i: " ".join(r.choice(POOL) for _ in range(r.randint(1, longest))) for i in range(n)}
