"""Column expressions: region ids, name rules, effect signs, intervals of proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: they must match the tools whose results are compared -----------------------------------------------
REGION = r"^(chr\w+):(\d+)-(\d+)$"
BARCODE = r"^[ACGTNacgtn]{10,20}(-\d+)?$"
ACCESSION = r"GSE\d+"
ERYTHROID_GENES = (
    "hba-a1", "hba-a2", "hba-x", "hbb-bs", "hbb-bt", "hbb-bh1", "hbb-y", "hbb-bh2", "hbq1a", "hbq1b",
    "alas2", "slc4a1", "gypa", "ermap", "rhd", "rhag", "ahsp", "erdr1",
)
GENOTYPE_PATTERNS = {
    "wildtype": (r"\bwt\d*\b", r"wild.?type"),
    "knockout": (r"\bko\d*\b", r"knock.?out", r"-/-", r"\bnull\b"),
    "heterozygous": (r"\bhet\d*\b", r"heterozygous"),
    "homozygous": (r"\bhomo\d*\b", r"homozygous"),
    "mutant": (r"\bmut\d*\b", r"mutant"),
    "control": (r"\bctrl\d*\b", r"\bctl\d*\b", r"\bcontrol\b"),
}
TREATMENT_PATTERNS = {
    "treated": (r"treat(?!ment\b)\w*",),
    "untreated": (r"untreat\w*",),
    "chir": (r"\bchir\b",),
    "dapt": (r"\bdapt\b",),
    "tamoxifen": (r"tamoxifen",),
    "vehicle": (r"\bvehicle\b",),
}
AGE_PATTERNS = (r"\bp\d{1,3}\b", r"\bd\d{1,3}\b", r"\d+\s*mo(?![a-z])", r"e\d{1,2}\.\d")
OVEREXPRESSION_WORDS = ("OE", "ACTIVATION", "CRISPRA", "OVEREXPRESSION")
TF_NAME_PATTERNS = {"atoh1": "Atoh1", "pou4f3": "Pou4f3", "gfi1": "Gfi1", "tbx2": "Tbx2"}
VALUE_SUFFIXES = ("value", "rpkm", "fpkm", "reads", "counts")
# ------------------------------------------------------------------------------------------------------ end fixed values


# ---- regions ----------------------------------------------------------------------------------------------------------
def region_chrom(c: Column) -> Column:
    return F.when(c.rlike(REGION), F.regexp_extract(c, REGION, 1))


def region_start(c: Column) -> Column:
    return F.when(c.rlike(REGION), F.regexp_extract(c, REGION, 2)).try_cast("bigint")


def region_end(c: Column) -> Column:
    return F.when(c.rlike(REGION), F.regexp_extract(c, REGION, 3)).try_cast("bigint")


def format_region(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


# ---- feature flags ----------------------------------------------------------------------------------------------------
def is_mitochondrial(name: Column) -> Column:
    return F.startswith(F.lower(name), F.lit("mt-"))


def is_erythroid(name: Column) -> Column:
    return F.lower(name).isin(*ERYTHROID_GENES)


# ---- sample names -----------------------------------------------------------------------------------------------------
_DROPPED_TAIL = r"(?i)^(\d+|[a-z]|[a-z]\d{1,3}|rep\d*|" + "|".join(VALUE_SUFFIXES) + r")$"


def name_prefix(name: Column) -> Column:
    """Condition label of a sample name: trailing replicate tokens go, a fused number leaves its word.

    Walking the tokens from the right, the first one that survives ends the removal. A word with a fused number is cut
    to its word, and the shortened word is tested once more (``x rep2a1`` style tails collapse further), while the first
    token always stays.
    """
    tokens = F.filter(F.split(name, r"[_\-\s]+"), lambda t: t != "")
    state = F.struct(F.lit(False).alias("kept"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        # Not yet stopped: drop replicate tokens; otherwise keep the token, without its fused number.
        word = F.regexp_replace(t, r"^([A-Za-z]+)\d+$", "$1")
        gone = ~acc["kept"] & (t.rlike(_DROPPED_TAIL) | word.rlike(_DROPPED_TAIL))
        kept = F.when(acc["kept"], t).otherwise(word)
        return F.struct(
            (acc["kept"] | ~gone).alias("kept"),
            F.when(gone, acc["out"]).otherwise(F.array_append(acc["out"], kept)).alias("out"),
        )

    tail = F.reverse(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))))
    walked = F.aggregate(tail, state, step)
    first = F.when(
        walked["kept"], F.element_at(tokens, 1)
    ).otherwise(F.regexp_replace(F.element_at(tokens, 1), r"^([A-Za-z]+)\d+$", "$1"))
    rest = F.reverse(walked["out"])
    joined = F.array_join(F.concat(F.array(first), rest), "_")
    return F.lower(F.when(F.size(tokens) > 0, joined).otherwise(name))


def normalised_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def buckets_of(name: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """Sorted names of the buckets whose patterns occur in the (normalised) name."""
    n = normalised_name(name)
    found = [F.when(n.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(b)) for b, ps in sorted(patterns.items())]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def ages_of(name: Column) -> Column:
    """Distinct age texts of a name, sorted."""
    n = normalised_name(name)
    hits = [F.regexp_extract_all(n, F.lit(f"(?i)({p})"), F.lit(1)) for p in AGE_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*hits)))


def is_barcode(name: Column) -> Column:
    return name.rlike(BARCODE)


# ---- ids in text ------------------------------------------------------------------------------------------------------
def accessions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ACCESSION})"), F.lit(1))


def dataset_of(sample: Column) -> Column:
    """The accession an id starts with, else the id."""
    return F.when(sample.rlike(f"^{ACCESSION}"), F.regexp_extract(sample, f"^({ACCESSION})", 1)).otherwise(sample)


def parse_list(c: Column) -> Column:
    """``['a', 'b']`` to an array; NULL when it is no list."""
    return F.from_json(F.translate(c, "'", '"'), "array<string>")


def variant_mode(c: Column) -> Column:
    return F.element_at(F.split(c, "__", 2), 1)


def variant_tf(c: Column) -> Column:
    return F.try_element_at(F.split(c, "__", 2), F.lit(2))


def tf_from_text(c: Column, patterns: dict[str, str] = TF_NAME_PATTERNS) -> Column:
    """Name of the first known factor whose lower-case name occurs in the text."""
    out = F.lit(None).cast("string")
    for needle, tf in reversed(list(patterns.items())):
        out = F.when(F.contains(F.lower(c), F.lit(needle)), F.lit(tf)).otherwise(out)
    return out


# ---- effects ----------------------------------------------------------------------------------------------------------
def longevity_sign(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t == "pro-longevity", 1).when(t == "anti-longevity", -1)


def senescence_sign(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(F.startswith(t, F.lit("inhibit")), 1).when(F.startswith(t, F.lit("induc")), -1)


def perturb_class(directions: Column) -> Column:
    """``OE``, ``KD`` or ``mixed`` for an array of direction words."""
    up = F.transform(directions, lambda x: F.upper(x).isin(*OVEREXPRESSION_WORDS))
    some, every = F.exists(up, lambda x: x), F.forall(up, lambda x: x)
    return F.when(F.size(up) == 0, "mixed").when(every, "OE").when(some, "mixed").otherwise("KD")


def arm_dimensions(dimensions: Column, single_arm: Column) -> Column:
    """Comma list of the test dimensions; a single arm cannot address dimension 3."""
    return F.array_join(F.when(single_arm, F.array_remove(dimensions, "3")).otherwise(dimensions), ",")


# ---- numbers ----------------------------------------------------------------------------------------------------------
def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; NULL for n = 0."""
    zz = F.lit(z * z)
    share = F.try_divide(k.cast("double"), n.cast("double"))
    den = F.lit(1.0) + F.try_divide(zz, n.cast("double"))
    centre = (share + F.try_divide(zz, n.cast("double") * F.lit(2.0))) / den
    spread = F.try_divide(share * (F.lit(1.0) - share), n.cast("double")) + F.try_divide(
        zz, n.cast("double") * n.cast("double") * F.lit(4.0)
    )
    half = F.lit(z) * F.sqrt(spread) / den
    return centre - half, centre + half


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def is_clear(lo: Column, hi: Column) -> Column:
    """An interval that does not hold zero."""
    return (lo > 0) | (hi < 0)


def draw(n: Column, *parts: Column) -> Column:
    """Reproducible draw in 0..n-1 from the text of its key; the same in any engine and for any partitioning."""
    return F.pmod(hash_key(*parts), n)


def hash_key(*parts: Column) -> Column:
    """60 bits of the md5 of the key's text: more than any group has rows, so a draw reaches every position."""
    return key_hash(F.concat_ws("|", *[p.cast("string") for p in parts]))


def key_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


# ------------------------------------------------------------------------------------------------------------ JSON specs
VARIANT_SPEC = "struct<id:string,tfs:array<string>,mode:string>"


def json_spec(text: str | Column, schema: str) -> Column:
    """A JSON text read with an explicit schema; text that does not fit it is NULL."""
    return F.from_json(text, schema)


def json_list(text: str | Column, element: str) -> Column:
    """The elements of a JSON list, one row each, read as ``element`` (a DDL type)."""
    return F.explode(F.from_json(text, f"array<{element}>"))


def variant_problem(spec: Column) -> Column:
    """What is wrong with one variant (id, tfs, mode), NULL when nothing is."""
    return (
        F.when(spec["id"].isNull() | (spec["id"] == "__baseline_mean__"), F.lit("id is missing or reserved"))
        .when(~F.coalesce(spec["mode"].isin("ko", "oe"), F.lit(False)), F.lit("mode is neither ko nor oe"))
        .when(F.coalesce(F.size(spec["tfs"]), F.lit(0)) < 1, F.lit("tfs is empty"))
    )
