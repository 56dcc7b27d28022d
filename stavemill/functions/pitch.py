"""Pitch scalars (T11-T25) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import ColumnLike, col
from .vocab import lookup

# Sharp names by pitch class, flat names, black-key labels, letters.
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLAT_NAMES = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
FLAT_TO_SHARP = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
BLACK_LABEL = {"C#": "1", "D#": "2", "F#": "3", "G#": "4", "A#": "5"}
LETTERS = "CDEFGAB"
# Printed durations (in quarters) in preference order for snapping.
SNAP_DURATIONS = ((4.0, "1/1"), (3.0, "3/4"), (2.0, "1/2"), (1.5, "3/8"), (1.0, "1/4"),
                  (0.75, "3/16"), (0.5, "1/8"), (0.375, "3/32"), (0.25, "1/16"),
                  (0.125, "1/32"))
MIN_MIDI, MAX_MIDI = 36, 95


def pitch_name(p: ColumnLike) -> Column:
    """Spelling without the octave digit; empty for the empty pitch."""
    p = col(p)
    return F.left(p, F.length(p) - 1)


def pitch_octave(p: ColumnLike) -> Column:
    return F.right(col(p), F.lit(1)).try_cast("int")


def letter_index(p: ColumnLike) -> Column:
    """0..6 for C..B."""
    return F.instr(F.lit(LETTERS), F.left(col(p), F.lit(1))) - 1


def normalize_pitch(p: ColumnLike) -> Column:
    """Five flats become sharps; the empty pitch stays empty."""
    p = col(p)
    name = pitch_name(p)
    return F.when(p == "", p).otherwise(
        F.concat(lookup(name, FLAT_TO_SHARP, name), F.right(p, F.lit(1))))


def pitch_class(name: ColumnLike) -> Column:
    return lookup(col(name), {n: i for i, n in enumerate(NOTE_NAMES)})


def pitch_to_midi(p: ColumnLike) -> Column:
    """Sharp spellings only; NULL for unknown names."""
    return ((pitch_octave(p) + 1) * 12 + pitch_class(pitch_name(p))).cast("int")


def midi_of(p: ColumnLike) -> Column:
    """MIDI number of any vocabulary spelling."""
    return pitch_to_midi(normalize_pitch(p))


def name_of_class(pc: Column, names=NOTE_NAMES) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), pc.cast("int"))


def midi_to_pitch(n: ColumnLike) -> Column:
    """T13."""
    n = col(n)
    return F.concat(name_of_class(F.pmod(n, F.lit(12))),
                    (F.floor(n / 12) - 1).cast("string"))


def note_frequency(p: ColumnLike) -> Column:
    """Equal temperament, A4 = 440."""
    semi = pitch_class(pitch_name(p))
    return 440.0 * F.pow(F.lit(2.0), (semi + (pitch_octave(p) - 4) * 12 - 9) / 12)


def playback_velocity(p: ColumnLike) -> Column:
    """Low notes are struck harder."""
    amount = F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                     (261.63 - note_frequency(p)) / (261.63 - 55)))
    return F.least(F.lit(127), F.floor(100 + amount * 25 + 0.5)).cast("int")


def diatonic_step(p: ColumnLike) -> Column:
    """Accidental ignored."""
    return (pitch_octave(p) * 7 + letter_index(p) + 1).cast("int")


def pitch_zone(p: ColumnLike, clef: ColumnLike) -> Column:
    """Display zone 0 (top) to 2."""
    o, bass = pitch_octave(p), col(clef) == "bass"
    return (F.when(bass & (o >= 4), 0).when(bass & (o == 3), 1).when(bass, 2)
            .when(o >= 6, 0).when(o == 5, 1).otherwise(2))


def pitch_row(p: ColumnLike, clef: ColumnLike) -> Column:
    """The four-row variant."""
    o, bass = pitch_octave(p), col(clef) == "bass"
    return (F.when(bass & (o >= 4), 0).when(bass & (o == 3), 1).when(bass & (o == 2), 2)
            .when(bass, 3)
            .when(o >= 6, 0).when(o == 5, 1).when(o == 4, 2).otherwise(3))


def note_label(p: ColumnLike) -> Column:
    """Letter, or 1..5 for black keys."""
    name = pitch_name(p)
    return lookup(name, BLACK_LABEL, name)


def chord_label(pitches: ColumnLike) -> Column:
    """Labels of an array of pitches, concatenated."""
    return F.array_join(F.transform(col(pitches), note_label), "")


def snap_duration(quarters: ColumnLike) -> Column:
    """struct(token, off) for the nearest printed value; first wins on equal distance."""
    q = col(quarters)
    best = F.least(*[F.struct(F.abs(q - v).alias("d"), F.lit(i).alias("o"), F.lit(t).alias("t"))
                     for i, (v, t) in enumerate(SNAP_DURATIONS)])
    return F.struct(best["t"].alias("token"), (best["d"] > 1e-6).alias("off"))


def respell_pitch(midi: ColumnLike, name: ColumnLike, accidental: ColumnLike) -> Column:
    """struct(pitch, respelled, out_of_range); octave always comes from the MIDI number."""
    midi, name = col(midi), col(name)
    pc = F.pmod(midi, F.lit(12))
    sharp, flat = name_of_class(pc), name_of_class(pc, FLAT_NAMES)
    keep = (name == sharp) | (name == flat)
    out = (F.when(keep, name)
           .when(F.coalesce(col(accidental) == "#", F.lit(False)), sharp).otherwise(flat))
    return F.struct(F.concat(out, (F.floor(midi / 12) - 1).cast("string")).alias("pitch"),
                    (~keep).alias("respelled"),
                    (~midi.between(MIN_MIDI, MAX_MIDI)).alias("out_of_range"))


def interval_degree(root: ColumnLike, cand: ColumnLike) -> Column:
    """Letter distance folded into an octave, 1-based."""
    return F.pmod(letter_index(cand) - letter_index(root), F.lit(7)) + 1


def staff_position(p: ColumnLike) -> Column:
    """Steps above the bottom treble line (E4 = 0)."""
    return (letter_index(p) - 2 + 7 * (pitch_octave(p) - 4)).cast("int")


def ledger_lines(p: ColumnLike) -> Column:
    """Ledger lines below step 0 or above step 8."""
    s = staff_position(p)
    return (F.when(s < 0, F.floor(-s / 2)).when(s > 8, F.floor((s - 8) / 2))
            .otherwise(0).cast("int"))
