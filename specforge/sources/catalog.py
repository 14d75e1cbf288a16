"""A product catalogue composed from the part table with integer arithmetic, alike in Spark and in SQL.

One family of products per leaf of the taxonomy and one that fits none. The numbers run over plausible and implausible
values, so that every extraction rule and nearly every finding occurs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> which value a record takes (k is the part's key), and the values
PICKS = {
    "rating": ("k // 27 % 6", ["1.1 kW", "4 kW", "15 kW", "5 HP", "37 kW", "20 kW"]),
    "mains": ("k // 9 % 7", ["230", "400", "24", "690", "300", "440", "110"]),
    "turns": ("k // 5 % 6", ["2950", "1460", "980", "1780", "2300", "1170"]),
    "seal": ("k // 3 % 4", ["54", "65", "67", "44"]),
    "pipe": ("k // 7 % 5", ["20", "32", "65", "125", "300"]),
    "heat": ("k // 11 % 5", ["90", "150", "-20", "350", "3500"]),
    "body": ("k // 13 % 8", ["ductile iron", "ss 316", "bronze", "pvc", "aluminium", "ptfe", "nylon", "ceramic"]),
    "mark": ("k // 17 % 5", ["UL", "ISO 14001", "RoHS", "API 610", "SIL 2"]),
    "class": ("k // 19 % 3", ["B", "F", "H"]),
    "grade": ("k // 23 % 4", ["IE2", "IE3", "IE4", "IE5"]),
    "fixing": ("k // 29 % 5", ["flange mounted", "foot mounted", "DIN rail", "skid mounted", "wall mounted"]),
    "thread": ("k // 31 % 4", ["M24", "G3/4", "NPT", "BSP"]),
}
NUMBERS = {
    "serial": "k % 7000 + 200", "kilos": "k * 11 % 400 + 1", "cubic": "k * 5 % 300 + 4", "bars": "k * 3 % 80 + 1", "amps": "k * 7 % 90 + 1", "loud": "k % 35 + 55",
    "wide": "k * 13 % 200 + 5", "round": "k % 60 + 10", "twist": "k * 19 % 900 + 15", "long": "k * 23 % 3000 + 50", "litres": "k * 29 % 700 + 3", "share": "k % 15 + 84", "watts": "k * 31 % 1500 + 40",
}
#: leaf, name and description of each family
FAMILIES = [
    ("PMP.CENT", "{brand} volute pump VP{serial}", "Casing of {body}. Flow rate: {cubic} m3/h, discharge pressure {bars} bar. Motor rating {rating} at {turns} rpm on {mains} V, port DN{pipe}."),
    ("PMP.SUB", "{brand} dewatering pump {serial}", "For a flooded well: capacity up to {cubic} m3/h, {rating}, IP{seal}, {mains} VAC single phase, cable length {long} mm."),
    ("PMP.POS", "{brand} metering pump {serial}", "Dosing at {litres} l/h against {bars} bar with a {body} head, {watts} W-rated drive and {watts} W."),
    ("MOT.IND", "{brand} squirrel cage motor {rating} S{serial}", "Three-phase, {mains} V 50 Hz, {turns} rpm, current rating {amps} A, IP{seal}, insulation class {class}, {grade}, {fixing}, S1 duty, efficiency: {share} %, net weight {kilos} kg, frame size 112L."),
    ("MOT.SRV", "{brand} brushless dc motor {serial}", "Closed loop with encoder, supply voltage {mains} VDC, rated torque {twist} Nm, speed {turns} rpm, {rating} output."),
    ("MOT.VFD", "{brand} frequency inverter {serial} {rating}", "Speed control over modbus, {mains} V, {amps} A load, 60 Hz, IP{seal}, {fixing}."),
    ("MOT.GBX", "{brand} worm gear {serial}", "Gear reduction with an output shaft, torque {twist} Nm, {turns} rpm, {rating}, gross weight {kilos} kg, {fixing}."),
    ("VLV.BALL", "{brand} ball valve {serial} DN{pipe}", "Quarter turn, flanged, working pressure {bars} bar, seat of {body}, max temperature {heat} C, {thread} drain."),
    ("VLV.GATE", "{brand} knife gate valve {serial}", "Rising stem and wedge, DN {pipe}, PN16 {bars} bar, {body}, operating temperature up to {heat}°C."),
    ("VLV.CTRL", "{brand} solenoid valve {serial}", "Pilot valve with a coil voltage of {mains} V, DN{pipe}, max pressure {bars} bar, {thread}, explosion proof, IP{seal}."),
    ("BRG.ROLL", "{brand} thrust bearing {serial}", "Grease filled race and cage, bore {round} mm, width {wide} mm, up to {heat}°C, {kilos} g, {turns} rpm."),
    ("PTX.BELT", "{brand} timing belt {serial}", "Pitch for a small pulley: length {long} mm, wide {wide} mm, torque {twist} N-m, {body} cord."),
    ("INS.PRS", "{brand} pressure gauge {serial}", "Sensor with a diaphragm, range -{bars} bar, {mains} V supply, 4-20mA, ss 304 case, {thread}, IP{seal}."),
    ("INS.TMP", "{brand} thermocouple {serial}", "Probe for temperature of {heat} C, length: {long} mm, {body} sheath, {mark} listed."),
    ("INS.FLW", "{brand} rotameter {serial}", "Flow meter, {cubic} LPM, DN{pipe}, {bars} psi, totaliser with {mains} V."),
    ("INS.LVL", "{brand} level switch {serial}", "Float for a tank, long {long} mm, {mains} V, IP{seal}, {heat} °C, {body}."),
    ("ELC.PLC", "{brand} plc cpu {serial}", "Controller with ladder logic and ethernet/ip, operating voltage {mains} V, consumption {amps} mA, {fixing}, {mark}."),
    ("ELC.SWG", "{brand} circuit breaker {serial}", "Three pole trip unit, {mains} V, rated current {amps} A, frequency 50 Hz, {fixing}."),
    ("ELC.CBL", "{brand} armoured cable {serial}", "Copper conductor, core and sheath, grade {mains} V, carries {amps} A, length {long} m."),
    ("ELC.TRF", "{brand} isolation transformer {serial}", "Primary and secondary windings, {litres} kVA, {mains} V, {amps} A, 50 Hz, weight {kilos} kg."),
    ("AIR.CMP", "{brand} scroll compressor {serial}", "Air end and unloader, {rating}, pressure {bars} bar, air delivery {cubic} CFM, receiver {litres} L, noise level {loud} dBA, {mains} V."),
    ("AIR.FAN", "{brand} axial fan {serial}", "Ventilation with an airflow of {cubic} m3/h, power consumption {watts} W, {mains} V, {turns} rpm, sound {loud} dB."),
    ("FLT.IND", "{brand} bag filter {serial}", "Housing of {body}, element of ten micron, {cubic} GPM, {bars} bar, DN{pipe}, diameter {round} mm, wide {wide} mm."),
    ("SAF.PPE", "{brand} safety goggles", "Protective against every hazard, ATEX zone 2, CE and {mark}, {kilos} g."),
    ("MRO.TOOL", "{brand} angle grinder {serial}", "Tool with a chuck, {watts} W output, {mains} V, {turns} rpm, {twist} Nm, weighs {kilos} kg."),
    ("MRO.LUB", "{brand} gear oil {serial}", "Lubricant of viscosity iso vg, drum {litres} L, also in {litres} litre packs, up to {heat} C."),
    ("GEN.UNK", "{brand} crate {serial}", "Height {wide} mm, length {long} mm, width {wide} mm, weight {kilos} kg."),
]


def _fill(template: str) -> str:
    """SQL that puts the values into a template."""
    own = lambda name: "p_brand" if name == "brand" else name if name in PICKS else f"CAST({name} AS STRING)"
    pieces = [f"'{x}'" if i % 2 == 0 else own(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]
    return f"CONCAT({', '.join(pieces)})"


#: field -> the pick it was composed from, and what follows in the text
TRUTH = {"power": ("rating", ""), "voltage": ("mains", " V"), "rotational_speed": ("turns", " rpm"), "ip_rating": ("seal", ""), "nominal_bore": ("pipe", "")}


def truth_columns() -> str:
    """The leaf of every record and the values that its text was composed from, where its family's text has them."""
    holds = lambda pick: ", ".join(str(i) for i, f in enumerate(FAMILIES) if f"{{{pick}}}" in f[1] + f[2])
    value = {"ip_rating": "CONCAT('IP', seal)", "nominal_bore": "CONCAT('DN', pipe)"}
    columns = [f"CASE WHEN k % {len(FAMILIES)} IN ({holds(pick)}) THEN {value.get(f, f'CONCAT({pick}, {chr(39)}{after}{chr(39)})')} END AS x_{f}" for f, (pick, after) in TRUTH.items()]
    leaf = f"CASE k % {len(FAMILIES)} " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(FAMILIES)) + " END AS leaf"
    return ", ".join(["", leaf, *columns])


def catalog_sql(part: str, spark: bool, extra: str = "") -> str:
    """product_id, brand, name, description, category and a_* (the attributes' values) of every part, and extra columns."""
    pick = lambda at, values: f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    columns = [f"{pick(at, v)} AS {name}" for name, (at, v) in PICKS.items()] + [f"{e} AS {name}" for name, e in NUMBERS.items()]
    base = f"SELECT p_partkey AS k, p_brand, p_size, {', '.join(columns)} FROM (SELECT *, p_partkey AS k FROM {part})"
    family = lambda j: f"CASE k % {len(FAMILIES)} " + " ".join(f"WHEN {i} THEN {_fill(f[j])}" for i, f in enumerate(FAMILIES)) + " END"
    sql = f"""SELECT k AS product_id, p_brand AS brand, CASE WHEN k % 97 = 5 THEN ' ' WHEN k % 101 = 7 THEN 'P7' ELSE {family(1)} END AS name, {family(2)} AS description,
      CASE WHEN k % 27 = 7 AND k % 2 = 0 THEN 'Ball Valve' WHEN k % 27 = 6 AND k % 2 = 0 THEN ' mot.gbx ' WHEN k % 27 = 4 THEN 'Other goods' END AS category,
      CASE WHEN k % 3 = 0 THEN p_brand END AS a_brand, CASE WHEN k % 10 = 3 THEN CONCAT(CHR(9), CAST(p_size AS STRING), ' kW', CHR(10)) END AS a_power,
      CASE WHEN k % 12 = 6 THEN CAST(p_size AS STRING) WHEN k % 12 = 7 THEN CONCAT('-', CAST(p_size AS STRING), ' kg') END AS a_weight,
      CASE WHEN k % 11 = 4 THEN CONCAT(CAST(litres AS STRING), ' L') END AS a_capacity, CASE WHEN k % 13 = 5 THEN CONCAT(CAST(loud AS STRING), CHR(160), 'dB') END AS a_noise{extra} FROM ({base})"""
    return sql.replace("//", "DIV") if spark else sql


#: attribute name -> column of its value, by name
ATTRIBUTES = {"Brand": "a_brand", "Rated Power": "a_power", "capacity": "a_capacity", "net weight": "a_weight", "noise": "a_noise"}


#: Records of a part of the input, about: a part is a task, whose time must not grow with the table.
PART = 20_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, and to as many parts as keep a part at about PART rows, where it has fewer: reading records costs little, enriching them much."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, brand, name, description, category, source, source_ref and attributes (a map) of every part."""
    rows = spark.sql(catalog_sql("{part}", True), part=spread(spark.read.parquet(f"{sf_dir}/part.parquet")))
    attributes = "map_filter(map(" + ", ".join(f"'{k}', {c}" for k, c in ATTRIBUTES.items()) + "), (k, v) -> v IS NOT NULL)"
    return rows.selectExpr("product_id", "brand", "name", "description", "category", "'part' AS source", "concat('part:', product_id) AS source_ref", f"{attributes} AS attributes")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, leaf and expected (field -> value as written) of every record: what a right enrichment finds."""
    rows = spark.sql(catalog_sql("{part}", True, truth_columns()), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    expected = "map_filter(map(" + ", ".join(f"'{f}', x_{f}" for f in TRUTH) + "), (k, v) -> v IS NOT NULL)"
    return rows.selectExpr("product_id", "leaf", f"{expected} AS expected")
