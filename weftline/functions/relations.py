"""Relations, entity types and lanes of alignment rows, as Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EQUIVALENCE, SUBSUMED_BY, SUBSUMES, FLAGGED = "=", "<", ">", "?"
RELATIONS = ("=", "<", ">", "?")
SPELLINGS = {
    "=": "=", "==": "=", "equivalence": "=", "equivalent": "=", "equiv": "=", "": "=",
    "<": "<", "<=": "<", "&lt;": "<",
    ">": ">", ">=": ">", "&gt;": ">",
    "?": "?",
}
RELATION_CODES = {0: "<", -1: ">", -2: "="}
TYPES = ("CLS", "DPROP", "OPROP", "INST", "UNKNO")
TYPE_CODES = dict(enumerate(TYPES))
#: Entity kinds that a lane or a typed corpus may have.
KINDS = ("CLS", "OPROP", "DPROP", "INST")


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def normalise_relation(text: Column) -> Column:
    """One of = < > ?; null and unknown spellings are equivalences."""
    return F.coalesce(lookup(SPELLINGS, F.lower(F.trim(F.coalesce(text, F.lit(""))))), F.lit(EQUIVALENCE))


def exact_relation(text: Column) -> Column:
    """The trimmed text if it is exactly a relation, else an equivalence: a score in that place is no relation."""
    return F.when(F.trim(text).isin(*RELATIONS), F.trim(text)).otherwise(F.lit(EQUIVALENCE))


def reverse_relation(relation: Column) -> Column:
    return F.translate(relation, "<>", "><")


def canonical_cell(source: Column, target: Column, relation: Column) -> Column:
    """struct(a, b, r) that is the same for a cell and its reversal: a <= b; on a pair of one entity > counts as <."""
    turned = F.when(source > target, reverse_relation(relation)).when(source == target, F.translate(relation, ">", "<")).otherwise(relation)
    return F.struct(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), turned.alias("r"))


def pair_key(source: Column, target: Column) -> Column:
    """The unordered pair as an array; a pair of one entity has one element."""
    return F.array_sort(F.array_distinct(F.array(source, target)))


def decode(table: dict, code: Column, what: str) -> Column:
    """Text of an integer code; an unknown code fails the job."""
    return F.coalesce(lookup(table, code), F.raise_error(F.concat(F.lit(f"unknown {what} code "), F.coalesce(code.cast("string"), F.lit("null")))).cast("string"))


def relation_of_code(code: Column) -> Column:
    return decode(RELATION_CODES, code, "relation")


def type_of_code(code: Column) -> Column:
    return decode(TYPE_CODES, code, "type")


def known_kind(tag: Column) -> Column:
    """Upper-cased, trimmed type tag if it is an entity kind, else null."""
    clean = F.upper(F.trim(tag))
    return F.when(clean.isin(*KINDS), clean)


def require_kind(tag: Column) -> Column:
    return F.coalesce(known_kind(tag), F.raise_error(F.concat(F.lit("unknown entity kind "), F.coalesce(tag, F.lit("null")))).cast("string"))


def pair_lane(tag: Column, source_type: Column, target_type: Column) -> Column:
    """The tag decides; without one, instance before property before class among the derived types of both sides."""

    def either(*names: str) -> Column:
        return F.coalesce(source_type.isin(*names), F.lit(False)) | F.coalesce(target_type.isin(*names), F.lit(False))

    derived = F.when(either("INST"), "INST").when(either("OPROP"), "OPROP").when(either("DPROP"), "DPROP").otherwise("CLS")
    return F.coalesce(known_kind(tag), derived)


def lane_of_type(tag: Column, properties: str = "property") -> Column:
    """class, property, instance or unknown. properties: 'property' joins both property kinds, 'split' keeps them apart."""
    kind = known_kind(tag)
    split = properties == "split"
    return F.when(kind == "CLS", "class").when(kind == "OPROP", "object_property" if split else "property").when(kind == "DPROP", "data_property" if split else "property").when(kind == "INST", "instance").otherwise("unknown")


def uri_type(uri: Column) -> Column:
    """class, property, resource part of a knowledge-graph URI, in this order; else unknown."""
    return F.when(uri.contains("/class/"), "class").when(uri.contains("/property/"), "property").when(uri.contains("/resource/"), "instance").otherwise("unknown")


def mapping_type(source: Column, target: Column) -> Column:
    first = uri_type(source)
    return F.when(first != "unknown", first).otherwise(uri_type(target))


def typed_pair(source_type: Column, target_type: Column) -> Column:
    """class if both ends are classes, property if both are properties of any kind, else other."""
    both_class = (source_type == "CLS") & (target_type == "CLS")
    both_property = source_type.isin("OPROP", "DPROP") & target_type.isin("OPROP", "DPROP")
    return F.when(both_class, "class").when(both_property, "property").otherwise("other")


def local_name(uri: Column) -> Column:
    """Text after the last #, then after the last /."""
    return F.substring_index(F.substring_index(uri, "#", -1), "/", -1)


def label_of_uri(uri: Column) -> Column:
    """Text after # if there is one, else after the last /."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))
