"""The file families of the school statistics: layout of each, and its typed form."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.functions.numbers import count_value, marked_count, marked_share, share_value, strict_count, strict_share
from rankmill.operators.lines import LineFamily

# ---- Fixed values: file names, preamble patterns, columns by position, domains ----

ID_COLUMNS = ["kommun", "kommun_kod", "lan", "lan_kod", "huvudman_typ"]

PUPIL_SHARES = ["andel_flickor", "andel_utlandsbakgrund", "andel_hogutbildade_foraldrar"]
PUPIL_COUNTS = [f"elever_ak{grade}" for grade in range(1, 10)] + ["elever_totalt_1_9"]

COST_COUNTS = [
    "genomsnittligt_elevantal",
    "totalt",
    "undervisning",
    "totalt_per_elev",
    "undervisning_per_elev",
    "lokaler_per_elev",
    "maltider_per_elev",
    "larverktyg_per_elev",
    "elevhalsa_per_elev",
    "ovrigt_per_elev",
]

GROUPS = ["totalt", "flickor", "pojkar"]
TEST_SHARES = [f"{m}_{g}" for m in ("deltagit", "andel_ae", "betygspoang") for g in GROUPS]
TEST_COUNTS = [f"antal_af_{g}" for g in GROUPS]
TEST_COLUMNS = [f"{m}_{g}" for m in ("deltagit", "antal_af", "andel_ae", "betygspoang") for g in GROUPS]
SUBJECTS = ["Engelska", "Matematik", "Svenska", "Svenska som andraspråk"]

STAFF_SHARES = [
    f"{unit}_{m}"
    for unit in ("fte", "headcount")
    for m in ("totalt", "legitimerade", "andel_legitimerade", "forstelarare")
]

ELIGIBILITY = ["behorig_yrkes", "behorig_estet", "behorig_eko_hum_sam", "behorig_nat_tek"]
GENDERS = ["Flickor", "Pojkar", "Samtliga"]
PROVIDERS = ["Samtliga", "Kommunal", "Enskild"]

PUPILS = LineFamily(
    prefix="Grundskola - Antal elever per årskurs",
    boilerplate=["Kommun;%", "Valt läsår:%", "Statistik från Skolverket%"],
    year="lasar_start",
    columns=[*ID_COLUMNS, *PUPIL_SHARES, *PUPIL_COUNTS],
)

COSTS = LineFamily(
    prefix="Grundskola - Kostnader per kommun",
    boilerplate=[
        "Kommun;Kommunkod;%",
        "Grundskola - Kostnader per kommun%",
        "Valt år:%",
        "Endast kommunal huvudman%",
    ],
    year="year_start",
    columns=["kommun", "kommunkod", "lan", "lan_kod", "huvudman_typ", *COST_COUNTS],
)

TESTS = LineFamily(
    prefix="Grundskola - Resultat nationella prov årskurs 9",
    boilerplate=[
        "Kommun;Kommun-kod;Län;Läns-kod;Typ av huvudman;Ämne;%",
        "Statistik från Skolverket%",
        "Grundskola - Resultat nationella prov%",
        "Valt läsår:%",
        ";;;;;;Andel (%) elever som deltagit%",
        "Under vårterminen%",
        "Skolverket rekommenderade%",
        "För provbetyget%",
    ],
    year="lasar_start",
    columns=[*ID_COLUMNS, "amne", *TEST_COLUMNS],
    domain={"amne": SUBJECTS},
)

STAFF = LineFamily(
    prefix="Grundskola - Personalstatistik med lärarlegitimation",
    boilerplate=[
        "Kommun;Kommun-kod;%",
        "Statistik från Skolverket%",
        "Valt läsår:%",
        "Valt uttag:%",
        "Från och med läsåret%",
    ],
    year="lasar_start",
    columns=[*ID_COLUMNS, *STAFF_SHARES],
)

ELIGIBLE = LineFamily(
    file="behorighet_grundskola_2024_25.csv",
    boilerplate=[
        "Statistik från Skolverket%",
        "Grundskola - Behörighet%",
        "Valt läsår:%",
        "Inför nya gymnasieskolan%",
        "Kommun;Kommun-kod;%",
    ],
    columns=["kommun", "kommun_kod", "lan", "lans_kod", "huvudman_typ", "kon", "antal_elever", *ELIGIBILITY],
    domain={"kon": GENDERS, "huvudman_typ": PROVIDERS},
    trimmed=True,
)

# ---- Typed forms ----

Reader = Callable[[str], Column]


def typed(df: DataFrame, readers: Mapping[Reader, Sequence[str]]) -> DataFrame:
    """Replace text columns by what their reader makes of them."""
    return df.withColumns({c: reader(c) for reader, columns in readers.items() for c in columns})


def plain_count(c: str) -> Column:
    """Only ordinary spaces are thousands separators in these families."""
    return count_value(c, nbsp=False)


def plain_marked_count(c: str) -> Column:
    return marked_count(c, nbsp=False)


def typed_pupils(parsed: DataFrame) -> DataFrame:
    return typed(parsed, {share_value: PUPIL_SHARES, plain_count: PUPIL_COUNTS})


def typed_costs(parsed: DataFrame) -> DataFrame:
    return typed(parsed, {plain_count: COST_COUNTS})


def typed_tests(parsed: DataFrame) -> DataFrame:
    return typed(parsed, {marked_share: TEST_SHARES, plain_marked_count: TEST_COUNTS})


def typed_staff(parsed: DataFrame) -> DataFrame:
    return typed(parsed, {share_value: STAFF_SHARES})


def eligible_lines(raw: DataFrame) -> DataFrame:
    return ELIGIBLE.lines(raw).select("raw_line", "source_file").distinct()


def typed_eligible(lines: DataFrame) -> DataFrame:
    """Rows without a municipality are broken lines; other text than numbers and sentinels is an error."""
    rows = ELIGIBLE.parse(lines).filter(F.col("kommun").isNotNull() & (F.col("kommun") != "")).drop("source_file")
    return typed(rows, {strict_count: ["antal_elever"], strict_share: ELIGIBILITY})
