"""Label text to class id and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.literals import literal_array, literal_map
from flowspark.schema import LABELS, MISREAD_SEPARATOR, label_aliases

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def encode_label(raw: Column, strict=False) -> Column:
    """Class id of a label spelling; unknown text is benign.

    Tried in turn: the exact spelling, the spelling with a replacement character or an en dash
    put back to the file's dash, the spelling with misread bytes put back to a hyphen, and the
    first known spelling contained in the upper-cased text.
    """
    aliases = label_aliases(strict)
    lookup = literal_map(aliases, "int")
    text = F.regexp_replace(raw.cast("string"), _EDGE_SPACE, "")
    dashed = F.translate(text, "�–", "\x96\x96")
    hyphened = F.replace(text, F.lit(MISREAD_SEPARATOR), F.lit("-"))
    spellings = literal_array(s.upper() for s in aliases)
    first = F.filter(spellings, lambda s: F.contains(F.upper(text), s))
    ids = literal_map({s.upper(): i for s, i in aliases.items()}, "int")
    contained = F.try_element_at(ids, F.get(first, F.lit(0)))
    return F.coalesce(
        F.try_element_at(lookup, text),
        F.try_element_at(lookup, dashed),
        F.try_element_at(lookup, hyphened),
        contained,
        F.lit(0),
    )


def label_name(class_id: Column, unknown: Column = None) -> Column:
    """Class name of an id; an unknown id becomes its own text unless a column is given."""
    names = literal_map(LABELS)
    fallback = class_id.cast("string") if unknown is None else unknown
    return F.coalesce(F.try_element_at(names, class_id.cast("int")), fallback)
