"""Tag sets: Penn Treebank tags to universal tags and to word classes, and bracket names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which must equal the usual tables for equal results.
PENN_TO_UPOS = {
    "CC": "CONJ", "CD": "NUM", "EX": "PRON", "FW": "EX", "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "LS": "X", "MD": "AUX", "NNS": "NOUN",
    "NNP": "PROPN", "NNPS": "PROPN", "PDT": "DET", "POS": "PART", "PRP": "PRON", "PRP$": "PRON", "RBR": "ADV", "RBS": "ADV", "RP": "ADP",
    "UH": "INTJ", "WP": "PRON", "WP$": "PRON", "WRB": "ADV", "``": "PUNCT", "''": "PUNCT", "(": "PUNCT", ")": "PUNCT", "-LRB-": "PUNCT",
    "-RRB-": "PUNCT", ",": "PUNCT", ".": "PUNCT", ":": "PUNCT", "HYPH": "PUNCT", "#": "SYM", "$": "SYM", "ADD": "X", "AFX": "X", "GW": "X", "XX": "X",
}
INDEFINITE_PRONOUNS = ["somebody", "something", "someone", "anybody", "anything", "anyone", "everybody", "everything", "everyone", "nobody", "nothing"]
AUXILIARY_RELATIONS = ["aux", "aux:pass", "auxpass", "cop"]
DEMONSTRATIVES = ["this", "that", "these", "those"]
RELATIVES = ["that", "which"]
WORD_CLASSES = {
    "ADJ": ["CD", "JJ", "JJR", "JJS"],
    "ADV": ["RB", "RBR", "RBS", "RP", "WRB"],
    "CONJ/PREP": ["CC", "IN", "TO"],
    "DET": ["DT", "PDT"],
    "INTERJ": ["UH"],
    "PRON": ["EX", "PRP", "PRP$", "WDT", "WP", "WP$"],
    "PUNC": ["''", "(", ")", "[", "]", "{", "}", ",", ".", ":", "``", "-LRB-", "-RRB-", "-LSB-", "-RSB-", "-LCB-", "-RCB-", "HYPH", "NFP"],
    "SUBST": ["NN", "NNP", "NNPS", "NNS"],
    "UNC": ["#", "$", "AFX", "FW", "LS", "POS", "SYM", "XX"],
    "VERB": ["MD", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ"],
}
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def upos(lemma: Column, tag: Column, relation: Column, governor_tag: Column) -> Column:
    """The universal tag of a Penn tag, which for some tags depends on lemma, relation and the governor's tag."""
    lemma, relation, governor_tag = (F.coalesce(x, F.lit("")) for x in (lemma, relation, governor_tag))
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    rest = (
        F.when(tag == "TO", either((relation == "mark") & (governor_tag == "VB"), "PART", "ADP"))
        .when(tag.startswith("VB"), either(relation.isin(AUXILIARY_RELATIONS), "AUX", "VERB"))
        .when(tag.startswith("IN"), either(relation == "mark", "SCONJ", "ADP"))
        .when(tag == "NN", F.when(lemma == "%", "SYM").when(lemma.isin(INDEFINITE_PRONOUNS), "PRON").otherwise("NOUN"))
        .when(tag == "NFP", either(lemma.rlike(r"^(?:~+|\*+|-+)$"), "PUNCT", "SYM"))
        .when(tag == "RB", either(lemma == "not", "PART", "ADV"))
        .when(tag == "DT", either(lemma.isin(DEMONSTRATIVES) & (relation != "det"), "PRON", "DET"))
        .when(tag == "WDT", either(lemma.isin(RELATIVES) & (relation != "det"), "PRON", "DET"))
        .otherwise("_")
    )
    return lookup(tag, PENN_TO_UPOS, rest)


def word_class(tag: Column) -> Column:
    return lookup(tag, {t: c for c, ts in WORD_CLASSES.items() for t in ts}, F.lit("UNKNOWN"))


def brackets(form: Column) -> Column:
    return lookup(form, BRACKETS, form)
