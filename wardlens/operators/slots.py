"""Repeated microbiology slots of a wide record.

A record carries its slots as numbered columns, so everything that looks at the
slots of one record (activity rule, duplicates, naming) is an expression over its
own row: no shuffle, no window, no join. Rows are only multiplied at the end.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.constants import (
    ACTIVE,
    INACTIVE,
    KEY,
    MECHANISMS,
    RENAMED_ORGANISMS,
    SLOT_FIELDS,
    SLOT_PREFIXES,
    SLOT_PREFIXES_WITH_TIMES,
)
from wardlens.functions import parse_iso_date, parse_stamp
from wardlens.operators.columns import starting_with

ORGANISM, SAMPLED, MECHANISM, OTHER, STATE = (
    "microorganismo",
    "fechaMuestra",
    "mecanismoMR",
    "otroMecanismo",
    "estadoAislamiento",
)
ACTIVATED, INACTIVATED = "fechaActivacion", "fechaInactivacion"
Fields = Mapping[str, str]  # slot field -> column name
FIELD_ORDER = (STATE, ORGANISM, SAMPLED, MECHANISM, OTHER, ACTIVATED, INACTIVATED)


def slot_columns(
    df: DataFrame, prefixes: Sequence[str] = SLOT_PREFIXES_WITH_TIMES
) -> dict[int, Fields]:
    """Slot number -> field -> column name, read off the column names once."""
    slots: dict[int, dict[str, str]] = {}
    for name in starting_with(df, *prefixes):
        number = re.search(r"\d+$", name)
        field = next((f for text, f in SLOT_FIELDS if text in name), None)
        if number and field:
            slots.setdefault(int(number.group()), {})[field] = name
    return dict(sorted(slots.items()))


def slot_columns_used(df: DataFrame, prefixes: Sequence[str] = SLOT_PREFIXES) -> list[str]:
    """All slot column names; what a caller needs to read for the slot operators."""
    return [c for fields in slot_columns(df, prefixes).values() for c in fields.values()]


def _field(fields: Fields, name: str) -> str:
    return f"`{fields[name]}`" if name in fields else "CAST(NULL AS STRING)"


def _after_activity_rule(field: Mapping[str, str]) -> dict[str, str]:
    """What is left of a slot when inactive and broken-off parts are blanked.

    Fields come in the order state, organism, sample date, mechanism, other
    mechanism. An inactive or missing state blanks the organism; from there on a
    missing field blanks the next one. The last field looks back at the recorded
    fields only, not at the state.
    """
    state, organism, sampled, mechanism, other = (field[f] for f in FIELD_ORDER[:5])
    not_closed = f"{state} <> '{INACTIVE}'"
    broken_off = f"{state} = '{ACTIVE}' AND {organism} IS NULL"
    live = f"{not_closed} AND {organism} IS NOT NULL"
    dated = f"{organism} IS NOT NULL AND {sampled} IS NOT NULL"
    return {
        STATE: f"CASE WHEN {not_closed} AND NOT ({broken_off}) THEN {state} END",
        ORGANISM: f"CASE WHEN {live} THEN {organism} END",
        SAMPLED: f"CASE WHEN {live} THEN {sampled} END",
        MECHANISM: f"CASE WHEN {live} AND {sampled} IS NOT NULL THEN {mechanism} END",
        OTHER: f"CASE WHEN {dated} AND {mechanism} IS NOT NULL THEN {other} END",
    }


def _require_state(slots: Mapping[int, Fields]) -> None:
    if any(STATE not in fields for fields in slots.values()):
        raise ValueError("the activity rule needs a state column for every slot")


def _raw_slots(slots: Mapping[int, Fields], names: Sequence[str]) -> list[str]:
    """One struct per slot as SQL: its number and its recorded fields."""
    return [
        f"named_struct('slot', {n}, "
        + ", ".join(f"'{f}', {_field(fields, f)}" for f in names)
        + ")"
        for n, fields in slots.items()
    ]


def _named_values(df: DataFrame, key: str, values: Mapping[str, str]) -> DataFrame:
    """Exploded slots to (key, slot, name, value); missing values drop out."""
    pairs = ", ".join(
        f"named_struct('name', '{name}', 'value', CAST({value} AS STRING))"
        for name, value in values.items()
    )
    long = df.selectExpr(f"`{key}`", "_slot.slot", f"inline(array({pairs}))")
    return long.filter(F.col("value").isNotNull())


def _exploded(df: DataFrame, key: str, slots: Mapping[int, Fields], names: Sequence[str]):
    array = ", ".join(_raw_slots(slots, names))
    return df.selectExpr(f"`{key}`", f"explode(array({array})) AS _slot")


def slots_long(
    df: DataFrame, key: str = KEY, prefixes: Sequence[str] = SLOT_PREFIXES
) -> DataFrame:
    """(key, slot, name, value) for every recorded slot field."""
    slots = slot_columns(df, prefixes)
    names = [f for f in FIELD_ORDER if any(f in fields for fields in slots.values())]
    return _named_values(_exploded(df, key, slots, names), key, {f: f"_slot.{f}" for f in names})


def active_slots_long(df: DataFrame, key: str = KEY) -> DataFrame:
    """(key, slot, name, value) for what the activity rule leaves of each slot."""
    slots = slot_columns(df, SLOT_PREFIXES)
    _require_state(slots)
    names = FIELD_ORDER[:5]
    left = _after_activity_rule({f: f"_slot.{f}" for f in names})
    return _named_values(_exploded(df, key, slots, names), key, left)


def mechanism_label(c: Column, mechanisms: Sequence[tuple[str, str, str]] = MECHANISMS) -> Column:
    """Short label of a resistance mechanism; null when it is not a listed one."""
    tests = {
        "equals": lambda text: c == text,
        "contains": lambda text: c.contains(text),
        "starts": lambda text: c.startswith(text),
    }
    labels = [F.when(tests[how](text), F.lit(label)) for how, text, label in mechanisms]
    return F.coalesce(*labels)


def organism_name(c: Column) -> Column:
    """Organism under its current scientific name."""
    renamed = [F.when(c == old, F.lit(new)) for old, new in RENAMED_ORGANISMS.items()]
    return F.coalesce(*renamed, c)


def organism_rows(
    df: DataFrame,
    carry: Sequence[str] = (KEY,),
    *,
    active_only: bool = True,
    mechanisms: Sequence[tuple[str, str, str]] = MECHANISMS,
    keep_mechanism: bool = False,
    keep_state: bool = False,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per record and distinct organism, next to the ``carry`` columns.

    Within a record the first slot of each (organism, raw mechanism) pair is kept;
    only then is the mechanism shortened and appended to the organism, so two raw
    spellings of one mechanism stay two rows.

    ``active_only``     apply the activity rule first
    ``mechanisms``      which mechanisms get a label
    ``keep_mechanism``  also return the label as ``mecanismoMR``
    ``keep_state``      also return slot state, activation and inactivation times
    ``keep_empty``      keep records without organisms, with nulls (a left join)
    """
    slots = slot_columns(df)
    if active_only:
        _require_state(slots)
    extra = (STATE, ACTIVATED, INACTIVATED) if keep_state else ()
    names = list(dict.fromkeys((*FIELD_ORDER[:5], *extra)))
    kept = [f"`{c}`" for c in carry]

    # step 1: the slots as recorded, and for each slot that counts what it is a repeat of
    repeat_keys = []
    for fields in slots.values():
        values = {f: _field(fields, f) for f in names}
        if active_only:
            values |= _after_activity_rule(values)
        repeat_keys.append(
            f"concat({values[ORGANISM]}, '\\u0001', coalesce({values[MECHANISM]}, '\\u0001'))"
        )
    raw = _raw_slots(slots, names)
    blank = [f"IF(true, NULL, {raw[0]})"] if keep_empty else []
    staged = df.selectExpr(
        *kept,
        f"array({', '.join([*raw, *blank])}) AS _slots",
        f"array({', '.join(repeat_keys)}) AS _keys",
    )

    # step 2: one row per slot; only live slots that repeat no earlier one stay
    first = "array_position(_keys, get(_keys, _pos)) = _pos + 1"
    if keep_empty:
        first = f"IF(_pos < {len(slots)}, {first}, array_join(_keys, '') = '')"
    rows = staged.selectExpr(*kept, "_keys", "posexplode(_slots) AS (_pos, _slot)").filter(first)
    values = {f: f"_slot.{f}" for f in names}
    if active_only:  # what the activity rule comes to for a live slot
        dated = f"{values[SAMPLED]} IS NOT NULL"
        values[OTHER] = f"IF({dated} AND {values[MECHANISM]} IS NOT NULL, {values[OTHER]}, NULL)"
        values[MECHANISM] = f"IF({dated}, {values[MECHANISM]}, NULL)"
    exploded = rows.selectExpr(
        *kept, "_slot.slot", *[f"{values[f]} AS {f}" for f in (*FIELD_ORDER[1:5], *extra)]
    )

    # step 3: names and labels, one row at a time; a date kept as text is read, if it is one
    kinds = dict(exploded.dtypes)
    sampled = parse_iso_date if kinds[SAMPLED] == "string" else F.to_date
    stamps = [
        parse_stamp(F.col(c)).alias(c) if kinds[c] == "string" and c != STATE else F.col(c)
        for c in extra
    ]
    label = mechanism_label(F.col(MECHANISM), mechanisms)
    named = F.concat_ws(" ", organism_name(F.col(ORGANISM)), label)
    return exploded.select(
        *carry,
        "slot",
        F.when(F.col(ORGANISM).isNotNull(), named).alias(ORGANISM),
        sampled(F.col(SAMPLED)).alias(SAMPLED),
        OTHER,
        *([label.alias(MECHANISM)] if keep_mechanism else []),
        *stamps,
    )


def join_organisms(
    records: DataFrame, organisms: DataFrame, key: str = KEY, null_safe: bool = False
) -> DataFrame:
    """Records with the rows of a separately stored organism table; none are lost."""
    if not null_safe:
        return records.join(organisms, key, "left")
    right = organisms.withColumnRenamed(key, "_right_key")
    return records.join(right, F.col(key).eqNullSafe(F.col("_right_key")), "left").drop("_right_key")
