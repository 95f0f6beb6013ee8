"""The claims of an answer: every quantity, formula, space group and assertion in it, once, with its scope.

Rules, threshold sweeps and ablations are predicates over `claims`; no pattern is matched again for them.
Everything is row-local: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.spans import any_in, clause_of, cut, sentence_of, spans


IR = {k: f"ir_{k}" for k in ("claims", "quantity", "element", "negates_stability", "stability_evidence", "metal", "insulator", "systems")}


def quantity_of(question: Column) -> Column:
    """The physical quantity that a question names, by the first of the lexicon's."""
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for name, words in reversed(L.QUANTITIES):
        out = F.when(any_in(low, words), F.lit(name)).otherwise(out)
    return out


def _kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), m["value"].alias("text")))


def _first(found: Column) -> Column:
    return F.slice(found, 1, 1)


def formula_valid(formula: Column) -> Column:
    elements = F.array(*map(F.lit, [*L.ELEMENTS, "M"]))
    return formula.isin(*L.ACRONYMS) | F.forall(F.regexp_extract_all(formula, F.lit(L.ELEMENT), F.lit(0)), lambda e: F.array_contains(elements, e))


def formula_candidate(formula: Column) -> Column:
    return ~formula.isin(*L.ACRONYMS) & formula.rlike("[a-z0-9]")


def with_claims(rows: DataFrame, question: str | None = "question", answer: str = "answer", since: Column | None = None) -> DataFrame:
    """rows plus a column for each name of IR: the claims and the answer's flags. Null texts are empty.
    since: an offset in the answer; claims that start before it do not count, nor do words before it for the flags.

    They come out of a generator of one row, through which no filter is pushed and no expression is inlined, so
    the patterns are matched once for a record whatever is asked of the claims."""
    a, q = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(question), F.lit("")) if question else F.lit("")
    kept = rows.columns
    df = rows.withColumns({"_a": a, "_q": q, "_low": F.lower(a), "_quantity": quantity_of(q)})
    own = F.col("_low") if since is None else F.lower(F.substring(F.col("_a"), since + 1, F.length("_a")))
    skipped = None if since is None else F.length(F.lower(F.substring(F.col("_a"), F.lit(1), since)))  # a lower text may be longer

    def counted(found: Column, least: Column | None) -> Column:
        return found if least is None else F.filter(found, lambda c: c["start"] >= least)

    bare = F.when(F.col("_quantity") == "band_gap", _kind(spans(F.col("_a"), L.BARE_EV, 1), "bare_gap")).when(F.col("_quantity") == "formation_energy", _kind(spans(F.col("_a"), L.BARE_EV_PER_ATOM, 1), "bare_energy"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,raw:string,text:string>>")
    text = F.col("_a")

    def gated(word: str, found: Column) -> Column:
        """No pattern is tried on a text without the word that all of its matches hold. A Kelvin sign lowers to k."""
        return F.when(F.contains(F.col("_low"), F.lit(word)), found).otherwise(none)

    df = df.withColumns({
        "_ends": F.transform(spans(text, L.SENTENCE_END), lambda s: s["start"]),
        "_found": F.concat(
            gated("band gap", _kind(spans(text, L.BAND_GAP, 1), "gap")),
            gated("band gap", _kind(spans(text, L.EV_BAND_GAP, 1), "gap")),
            gated("formation energy", _kind(spans(text, L.FORMATION_ENERGY, 1), "energy")),
            gated("k", _kind(spans(text, L.KELVIN, 1), "kelvin")),
            gated("pa", _kind(spans(text, L.PRESSURE, 1), "pressure")),
            F.filter(_kind(spans(text, L.FORMULA), "formula"), lambda c: formula_candidate(c["raw"])),
            F.when(any_in(F.col("_low"), ("space", "sg")), _kind(spans(text, L.SPACE_GROUP, 1), "space_group")).otherwise(none),
            gated("stab", _kind(_first(counted(spans(F.col("_low"), L.STABLE), skipped)), "stable")),
            gated("superconduct", _kind(_first(counted(spans(F.col("_low"), L.SUPERCONDUCTS), skipped)), "superconducts")),
            F.coalesce(bare, none),
        ),
    })
    df = df if since is None else df.withColumn("_found", F.filter("_found", lambda c: c["start"] >= F.when(c["kind"].isin("stable", "superconducts"), skipped).otherwise(since)))
    df = df.withColumn("_scoped", F.transform("_found", lambda c: F.struct(c.alias("c"), sentence_of(F.col("_a"), F.col("_ends"), c["start"], c["end"]).alias("sentence"))))
    df = df.withColumn("_scoped", F.transform("_scoped", lambda s: F.struct(s["c"].alias("c"), s["sentence"].alias("sentence"), (F.position(s["sentence"], F.col("_a")) - 1).alias("at"))))
    df = df.withColumn("_scoped", F.transform("_scoped", lambda s: F.struct(
        s["c"].alias("c"),
        F.lower(s["sentence"]).alias("sentence"),
        F.lower(clause_of(s["sentence"], F.greatest(F.lit(0), s["c"]["start"] - s["at"]), L.CLAUSE_END)).alias("clause"),
        F.regexp_extract(F.lower(cut(s["sentence"], F.greatest(F.lit(0), s["c"]["end"] - s["at"]), F.length(s["sentence"]))), L.LINKED_TAIL, 0).alias("tail"),
    )))
    claims = F.transform("_scoped", lambda s: F.struct(
        s["c"]["kind"].alias("kind"),
        F.when(~s["c"]["kind"].isin("formula", "stable", "superconducts"), s["c"]["text"].try_cast("double")).alias("value"),
        s["c"]["start"].alias("start"), s["c"]["end"].alias("end"), s["c"]["raw"].alias("raw"),
        (any_in(s["clause"], L.REJECTIONS) | ((s["tail"] != "") & any_in(s["tail"], L.REJECTIONS))).alias("rejected"),
        ((s["c"]["kind"] == "pressure") & any_in(s["sentence"], L.SIGN_CONVENTIONS)).alias("sign_convention"),
        (s["c"]["kind"].isin("energy", "bare_energy") & any_in(s["clause"], L.PHASE_QUALIFIERS)).alias("phase_qualified"),
        F.when(s["c"]["kind"] == "formula", formula_valid(s["c"]["raw"])).alias("formula_valid"),
        F.when(s["c"]["kind"] == "stable", s["sentence"].rlike(L.OTHER_STABILITY)).alias("other_stability"),
        F.when(s["c"]["kind"] == "superconducts", any_in(F.regexp_replace(s["clause"], L.NO_EVIDENCE, ""), L.SUPERCONDUCTIVITY_EVIDENCE)).alias("evidence"),
    ))
    low = own
    element = F.regexp_extract(F.trim(F.col("_q")), L.QUESTION_ELEMENT, 1)
    found = {
        "claims": claims, "quantity": F.col("_quantity"), "element": F.when(element.isin(*L.ELEMENTS), element),
        "negates_stability": any_in(low, ("not", "n't", "unstable")) & low.rlike(L.NOT_STABLE), "stability_evidence": any_in(low, L.STABILITY_EVIDENCE),
        "metal": F.contains(low, F.lit("metal")) & low.rlike(r"\b(?:metallic|metal)\b"), "insulator": F.contains(low, F.lit("insulat")) & low.rlike(r"\b(?:insulator|insulating)\b"),
        "systems": F.array_compact(F.array(*(F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in L.CRYSTAL_SYSTEMS))),
    }
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(IR[k]) for k, v in found.items())))))


def claims_long(rows: DataFrame, key: str) -> DataFrame:
    """One row for each claim."""
    return with_claims(rows).select(key, F.explode(IR["claims"]).alias("c")).select(key, "c.kind", "c.value", "c.raw", "c.rejected")
