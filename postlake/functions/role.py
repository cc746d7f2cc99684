"""Occupational roles of posting titles: the first pattern that fits names the role.

``ROLES`` is in order of precedence and holds fixed values: role, confidence, alternatives. The alternatives of a role form one
pattern, so a title is tested against one pattern per role, in one CASE expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions.text import neutral

# Fixed values.
ROLES = (
    ("rov-supervisor", "ROV Supervisor", "high", (r"\bROV\b.*\bsuper(?:intendent|visor)\b",)),
    ("rov-pilot-technician", "ROV Pilot/Technician", "high", (r"\bROV\b", r"remotely operated vehicle")),
    ("saturation-diver", "Saturation Diver", "high", (r"\bsaturation\b.*\bdiv(?:er|ing)\b", r"\bsat\b.*\bdiver\b")),
    ("dp-operator", "DP Operator", "high", (r"\bDP\b.*\boperator\b", r"\bdynamic\b.*\bposition(?:ing)?\b.*\boperator\b")),
    ("chief-engineer-marine", "Chief Engineer (Marine)", "high", (r"\bchief\b.*\bengineer\b.*\bmarine\b", r"\bmarine\b.*\bchief\b.*\bengineer\b")),
    ("subsea-engineer", "Subsea Engineer", "high", (r"\bsubsea\b", r"underwater")),
    ("ei-technician", "E&I Technician", "high", (r"\bE&I\b", r"\belectrical\b.*\binstrument(?:ation)?\b")),
    ("offshore-operations", "Offshore Operations", "medium", (r"\boffshore\b", r"offshore position")),
    ("diving-marine", "Diving & Marine", "medium", (r"\bdiving\b", r"\bdiver\b", r"\bmarine\b")),
    ("directional-drilling", "Directional Drilling", "high", (r"\bdirectional\b\s+\bdrilling\b", r"\bDD\b.*\bdrill", r"\bgeosteering\b", r"\bField\b\s+\bProf(?:essional)?\b.*\bDD\b", r"\bIngeniero\b\s+\bde\b\s+\bPerforación\b\s+\bDireccional\b")),
    ("mwd-lwd", "MWD/LWD Specialist", "high", (r"\bMWD\b", r"\bLWD\b", r"\bMLWD\b", r"measurement while drilling", r"logging while drilling", r"Field Prof.*MWD", r"Field Specialist.*LWD")),
    ("drilling-engineer", "Drilling Engineer", "high", (r"\bdrilling\b\s+\bengineer\b", r"\bdrill\b\s+\bbits\b.*\bengineer\b", r"\bmanaged\b\s+\bpressure\b\s+\bdrilling\b", r"\bMPD\b")),
    ("assistant-driller", "Assistant Driller", "high", (r"\bassistant\b.*\bdriller\b",)),
    ("driller-rig-crew", "Driller & Rig Crew", "high", (r"\bdriller\b", r"\brig\b.*\b(?:mechanic|electrician|crew)\b", r"\btoolpusher\b", r"\btool\b\s+\bpusher\b", r"\broughneck\b", r"\broustabout\b", r"\bderrick\b.*\b(?:hand|man)\b", r"\bwell\b\s+\bsite\b.*\bsup(?:ervisor)?\b")),
    ("mud-engineer", "Mud Engineer/Specialist", "high", (r"\bmud\b.*\bengineer\b", r"\bdrilling\b\s+\bfluids\b", r"\bBaroid\b")),
    ("wireline-operator", "Wireline Operator/Engineer", "high", (r"\bwireline\b", r"\bwire\b\s+\bline\b", r"\blogging\b.*\bperf(?:orating)?\b", r"\bL&amp;P\b", r"\bperforating\b\s+\bspecialist\b")),
    ("coiled-tubing", "Coiled Tubing Operator", "high", (r"\bcoiled\b\s+\btubing\b", r"\bCT\b.*\b(?:operator|engineer)\b")),
    ("cementing-services", "Cementing Services", "high", (r"\bcementing\b", r"\bcement\b.*\b(?:operator|technician|specialist)\b", r"\bSvc\b\s+\bOperator\b.*\bCement\b")),
    ("fracturing-stimulation", "Fracturing & Stimulation", "high", (r"\bfrac(?:turing|k)?\b", r"\bstimulation\b", r"\bacidizing\b", r"\bfracturamiento\b", r"\bIngeniero\b.*\bFrac\b", r"\bProduction\b\s+\bEnhancement\b")),
    ("well-testing", "Well Testing", "high", (r"\bwell\b\s+\btesting\b", r"\bsurface\b\s+\bwell\b\s+\btest(?:ing)?\b", r"\bSWT\b")),
    ("completions", "Completions Specialist", "high", (r"\bcompletions?\b", r"\bcompletion\b\s+\btools\b", r"\bcompletion\b\s+\bengineer\b")),
    ("workover-intervention", "Workover & Well Intervention", "high", (r"\bworkover\b", r"\bwork\b\s+\bover\b", r"\bwell\b\s+\bintervention\b")),
    ("slickline", "Slickline Operator", "high", (r"\bslickline\b", r"\bslick\b\s+\bline\b")),
    ("artificial-lift", "Artificial Lift Specialist", "high", (r"\bartificial\b\s+\blift\b", r"\bESP\b.*\b(?:engineer|specialist)\b", r"\belectric\b\s+\bsubmersible\b\s+\bpump\b", r"\brod\b\s+\bpump\b", r"\bPCP\b.*\b(?:engineer|specialist)\b")),
    ("production-operator", "Production Operator", "high", (r"\bproduction\b.*\boperator\b", r"\bwell\b\s+\boperator\b", r"\blease\b\s+\boperator\b", r"\bgauger\b", r"\bpumper\b")),
    ("process-operator", "Process Operator", "high", (r"\bprocess\b.*\boperator\b",)),
    ("plant-operator", "Plant Operator", "high", (r"\bplant\b.*\boperator\b",)),
    ("control-room-operator", "Control Room Operator", "high", (r"\bcontrol\b.*\broom\b.*\boperator\b",)),
    ("reactor-operator", "Reactor Operator", "high", (r"\breactor\b.*\boperator\b",)),
    ("crane-operator", "Crane Operator", "high", (r"\bcrane\b.*\boperator\b", r"\btower\b.*\bcrane\b")),
    ("production-engineer", "Production Engineer", "medium", (r"\bproduction\b.*\bengineer\b", r"\bproduction\b\s+\badvisor\b")),
    ("reservoir-engineer", "Reservoir Engineer", "high", (r"\breservoir\b.*\bengineer\b",)),
    ("petrophysicist", "Petrophysicist", "high", (r"petrophysicist", r"petrophysics")),
    ("geologist", "Geologist", "high", (r"\bgeologist\b", r"geology", r"geosteering geologist", r"logging geologist")),
    ("geophysicist", "Geophysicist", "high", (r"geophysicist", r"geophysics", r"seismic")),
    ("geoscientist", "Geoscientist", "medium", (r"geoscientist", r"geoscience")),
    ("petroleum-engineer", "Petroleum Engineer", "high", (r"\bpetroleum\b.*\bengineer\b", r"\bwell\b.*\bengineer\b", r"\bwell\b.*\bdesign\b")),
    ("field-engineer", "Field Engineer", "medium", (r"\bfield\b.*\bengineer\b", r"\bfield\b\s+\bprof(?:essional)?\b", r"\bfield\b\s+\bprofessional\b")),
    ("field-specialist", "Field Specialist/Technician", "medium", (r"\bfield\b.*\bspecialist\b", r"\bfield\b.*\btechnician\b", r"\bfield\b\s+\bservice\b")),
    ("service-operator", "Service Operator", "medium", (r"\bservice\b.*\boperator\b", r"\bsvc\b.*\boperator\b")),
    ("welder", "Welder", "high", (r"\bwelder\b", r"\bwelding\b", r"\bTIG\b.*\bweld", r"\bMIG\b.*\bweld", r"\bstick\b.*\bweld")),
    ("pipefitter", "Pipefitter", "high", (r"\bpipefitter\b", r"\bpipe\b.*\bfitter\b", r"\bsteamfitter\b")),
    ("scaffolder", "Scaffolder", "high", (r"\bscaffolder\b", r"\bscaffolding\b")),
    ("rigger", "Rigger", "high", (r"\brigger\b", r"rigging")),
    ("rig-mechanic", "Rig Mechanic", "high", (r"\brig\b.*\bmechanic\b", r"\bdiesel\b\s+\bmechanic\b")),
    ("millwright", "Millwright/Industrial Mechanic", "high", (r"\bmillwright\b", r"\bindustrial\b.*\bmechanic\b")),
    ("electrician-oilfield", "Electrician (Oilfield)", "medium", (r"\belectrical\b.*\btechnician\b", r"\belectrician\b", r"\belectrical\b.*\bpower\b\s+\bsystems\b")),
    ("instrumentation-tech", "Instrumentation Technician", "high", (r"\binstrumentation\b", r"\bI&C\b", r"\binstrument\b.*\bcontrol\b")),
    ("hydraulic-specialist", "Hydraulic Specialist", "medium", (r"\bhydraulic\b",)),
    ("mechanic-technician", "Mechanic/Technician (General)", "low", (r"\bmechanic\b.*\btechnician\b", r"\bmaintenance\b.*\btechnician\b", r"\btool\b.*\btechnician\b")),
    ("ndt-inspector", "NDT Inspector", "high", (r"\bNDT\b", r"\bnon\b.*\bdestructive\b.*\btest(?:ing)?\b", r"\bultrasonic\b.*\binspect(?:ion|or)?\b", r"\bradiographic\b.*\binspect(?:ion|or)?\b")),
    ("pipeline-inspector", "Pipeline Inspector", "high", (r"\bpipeline\b.*\binspect(?:ion|or)?\b",)),
    ("coating-inspector", "Coating Inspector", "high", (r"\bcoating\b.*\binspect(?:ion|or)?\b", r"\bpaint\b.*\binspect(?:ion|or)?\b")),
    ("structural-inspector", "Structural Inspector", "high", (r"\bstructural\b.*\binspect(?:ion|or)?\b",)),
    ("scada-engineer", "SCADA Engineer", "high", (r"\bSCADA\b", r"\bsupervisory\b.*\bcontrol\b")),
    ("automation-engineer", "Automation Engineer", "high", (r"\bautomation\b.*\bengineer\b", r"\bcontrol\b.*\bsystems\b.*\bengineer\b")),
    ("plc-technician", "PLC Technician", "high", (r"\bPLC\b", r"\bprogrammable\b.*\blogic\b")),
    ("data-analyst-energy", "Data Analyst (Energy)", "medium", (r"\bdata\b.*\banalyst\b.*\benergy\b", r"\benergy\b.*\bdata\b.*\banalyst\b")),
    ("wind-turbine-technician", "Wind Turbine Technician", "high", (r"\bwind\b.*\bturbine\b", r"\bWTT\b", r"\bturbine\b.*\btech(?:nician)?\b")),
    ("blade-technician", "Blade Technician", "high", (r"\bblade\b.*\btech(?:nician)?\b", r"\bblade\b.*\brepair\b")),
    ("ccs-engineer", "CCS Engineer", "high", (r"\bCCS\b.*\bengineer\b", r"\bcarbon\b.*\bcapture\b.*\bengineer\b", r"\bcarbon\b.*\bstorage\b")),
    ("hydrogen-engineer", "Hydrogen Engineer", "high", (r"\bhydrogen\b.*\bengineer\b",)),
    ("hydrogen-technician", "Hydrogen Technician", "high", (r"\bhydrogen\b.*\btech(?:nician)?\b",)),
    ("rope-access-technician", "Rope Access Technician", "high", (r"\brope\b.*\baccess\b", r"\bIRATA\b")),
    ("lab-technician", "Laboratory Technician", "medium", (r"\blab\b.*\btechnician\b", r"\blaboratory\b")),
    ("materials-specialist", "Materials Specialist", "medium", (r"\bmaterials\b.*\b(?:scientist|engineer|specialist)\b", r"\bmetallics\b", r"\bwelding\b.*\bengineer\b")),
    ("hse-specialist", "HSE Specialist", "medium", (r"\bHSE\b", r"\bhealth\b.*\bsafety\b.*\benvironment\b", r"\bwell\b\s+\bcontrol\b")),
)
# Occupation codes for which confidence is raised from medium.
PRIORITY_CODES = tuple(
    "47-2111.00 49-9021.00 51-4121.00 17-2199.11 17-2141.00 47-2152.00 17-2071.00 17-2141.01 47-2221.00 49-9051.00 17-3023.00 17-3026.00 51-8013.00 47-2031.00 49-9041.00 17-2112.00 11-9041.00".split()
)
# Categories in the order of display, with their labels and roles in the order of precedence.
CATEGORIES = {
    "drilling": ("Drilling & Well Services", "rov-supervisor rov-pilot-technician subsea-engineer saturation-diver diving-marine dp-operator chief-engineer-marine offshore-operations ei-technician drilling-operations driller-rig-crew assistant-driller directional-drilling drilling-engineer mud-engineer mwd-lwd wireline-operator slickline coiled-tubing cementing-services well-testing fracturing-stimulation completions workover-intervention artificial-lift"),
    "production": ("Production & Field Operations", "production-operator production-engineer process-operator plant-operator control-room-operator reactor-operator field-engineer field-specialist service-operator crane-operator"),
    "geoscience": ("Reservoir & Geoscience", "reservoir-engineer petroleum-engineer petrophysicist geologist geophysicist geoscientist geoscientists"),
    "engineering": ("Engineering", "engineering-electrical engineering-mechanical engineering-specialized"),
    "trades": ("Technical Trades", "welder pipefitter rigger scaffolder rig-mechanic millwright mechanic-technician electrical-trades electrician-oilfield instrumentation-tech hydraulic-specialist rope-access-technician maintenance-mechanics construction-trades equipment-operators ndt-inspector pipeline-inspector coating-inspector structural-inspector"),
    "technicians": ("Engineering Technicians", "engineering-technicians"),
    "operations": ("Plant & Process Operations", "plant-operators production-workers"),
    "management": ("Management", "engineering-management operations-management supply-chain-management"),
    "support": ("Support Functions", "business-analysts supply-chain-specialists hr-admin compliance-safety lab-technician materials-specialist hse-specialist"),
    "digital": ("Digital & IT", "scada-engineer automation-engineer plc-technician data-analyst-energy software-developers it-infrastructure data-specialists"),
    "renewable": ("Renewable & Energy Transition", "wind-turbine-technician blade-technician ccs-engineer hydrogen-engineer hydrogen-technician"),
    "sales": ("Sales & Marketing", "sales-engineers marketing-specialists"),
    "logistics": ("Transportation & Logistics", "transportation"),
    "other": ("Other Roles", "other"),
}
# Roles known by occupation codes, with their labels and codes. All other codes mean "other".
CODED_ROLES = {
    "drilling-operations": ("Drilling Operations", "47-5071.00 47-5013.00 47-5012.00 47-5023.00"),
    "petroleum-engineer": ("Petroleum Engineer", "17-2171.00"),
    "geoscientists": ("Geoscientists & Earth Scientists", "19-2042.00 19-4043.00 19-2099.01 19-4099.03 19-2012.00"),
    "engineering-electrical": ("Electrical & Electronics Engineers", "17-2071.00 17-2072.00"),
    "engineering-mechanical": ("Mechanical Engineers", "17-2141.00"),
    "engineering-specialized": ("Specialized Engineers", "17-2199.11 17-2111.00 17-2161.00 17-2199.09 17-2041.00 17-2011.00 17-2031.00 17-2121.00 17-2131.00 17-2151.00 17-2112.01"),
    "electrical-trades": ("Electricians & Electrical Repairers", "49-2095.00 47-2111.00 49-9051.00 49-2094.00"),
    "maintenance-mechanics": ("Maintenance & Mechanics", "49-9071.00 49-9012.00 49-9041.00 49-3023.00 49-2022.00 49-9097.00"),
    "construction-trades": ("Construction Trades", "47-2061.00 47-2051.00 47-4041.00 47-1011.00 47-1011.03"),
    "equipment-operators": ("Equipment Operators", "47-2073.00"),
    "engineering-technicians": ("Engineering Technicians", "17-3023.00 17-3027.00 17-3024.00 17-3026.00 17-3028.00 17-3029.08 17-3012.00"),
    "plant-operators": ("Plant & Process Operators", "51-8013.00 51-8021.00 51-8091.00 51-8093.00 51-8013.04 53-7071.00"),
    "production-workers": ("Production & Process Workers", "51-9199.00 51-9191.00 51-9011.00 51-9061.00 51-4111.00 51-9194.00 51-9021.00 51-4081.00 51-1011.00 51-9023.00 51-9198.00 51-4032.00 51-4199.00"),
    "engineering-management": ("Engineering & Technical Management", "11-9041.00 11-9041.01 11-9199.10 11-9021.00"),
    "operations-management": ("Operations & General Management", "11-1011.03 11-1021.00 11-3051.06"),
    "supply-chain-management": ("Supply Chain & Logistics Management", "11-3071.04 11-3071.00 11-3061.00 11-3013.00"),
    "business-analysts": ("Business & Financial Analysts", "13-2011.00 13-2051.00 13-1111.00 13-2052.00 13-2053.00 13-2081.00 13-2082.00 15-2051.00 15-2051.01"),
    "supply-chain-specialists": ("Supply Chain & Logistics Specialists", "13-1081.02 13-1022.00 13-1023.00 43-3061.00 43-5061.00"),
    "hr-admin": ("HR & Administrative", "43-3051.00 13-1141.00 11-3121.00 13-1151.00 43-1011.00 43-3031.00 43-6011.00 43-4051.00 43-9021.00"),
    "compliance-safety": ("Compliance, Safety & Quality", "11-9199.02 13-1041.07 13-1199.07 13-1199.04 11-9121.02 19-4031.00"),
    "software-developers": ("Software Development", "15-1252.00 15-1251.00 15-1253.00 15-1254.00"),
    "it-infrastructure": ("IT Infrastructure & Support", "15-1299.09 15-1231.00 15-1232.00 15-1211.00 15-1241.00 15-1244.00"),
    "data-specialists": ("Data & Analytics", "15-1243.01 15-1299.06"),
    "sales-engineers": ("Technical Sales", "41-9031.00 41-4011.00 41-1012.00 11-2022.00"),
    "marketing-specialists": ("Marketing & Communications", "27-3042.00 13-1161.01 13-1121.00 43-9031.00"),
    "transportation": ("Transportation & Logistics", "53-3032.00 53-1043.00 53-7062.00 53-4013.00 53-4041.00 53-5021.00 53-2022.00"),
    "other": ("Other Roles", ""),
}
# Words in a title that name a role where no code does.
TITLE_KEYWORDS = {"drilling-operations": ("driller", "toolpusher", "derrick hand", "roughneck", "floorhand", "rig crew", "drilling foreman", "tour pusher")}
LABELS = {role: name for role, name, _, _ in ROLES} | {role: label for role, (label, _) in CODED_ROLES.items()}


def dimension(spark: SparkSession) -> DataFrame:
    """role_id, label, category, category_label, place (of the category in its order), ord."""
    rows = [(role, LABELS[role], category, label, place) for place, (category, (label, roles)) in enumerate(CATEGORIES.items()) for role in roles.split()]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "role_id string, label string, category string, category_label string, place int, ord int")


def of_code(code: Column, title: Column) -> Column:
    """The role of an occupation code; else of a word in the title; else ``other``."""
    out = F.when(F.lit(False), "other")
    for role, (_, codes) in CODED_ROLES.items():
        if codes:
            out = out.when(code.isin(*codes.split()), role)
    low = F.lower(title)
    for role, keywords in TITLE_KEYWORDS.items():
        out = out.when(low.rlike("|".join(keywords)), role)
    return out.otherwise("other")


def validated(role_id: Column, level: Column) -> Column:
    """struct(role_id, confidence) of a remote answer: an unknown role or confidence counts as none."""
    known = role_id.isin(*LABELS) & level.isin("high", "medium", "low")
    return F.struct(F.when(known, role_id).alias("role_id"), F.when(F.coalesce(known, F.lit(False)), level).otherwise("none").alias("confidence"))


def decided(cached: Column, answer: Column, found: Column) -> Column:
    """match_type of a posting: a cached answer, a sure remote answer, a looked-up occupation, an unsure answer, or NULL."""
    level = answer["confidence"]
    return F.when(cached, "cache").when(level.isin("high", "medium"), "ai").when(found, "onet_fallback").when(level == "low", "ai_fallback")


def pattern(alternatives: tuple[str, ...]) -> str:
    """One pattern for all alternatives, for ``neutral`` text."""
    return "(?i)(?:" + "|".join(plain(x) for x in alternatives) + ")"


def plain(alternative: str) -> str:
    """An alternative as ``neutral`` text has it."""
    return "".join(c if c.isascii() else "§" for c in alternative)


def match(title: Column, description: Column | None = None, roles=ROLES) -> Column:
    """struct(role_id, role_name, confidence, keyword) of the first role that fits, or NULL; the keyword is what its first fitting alternative matched.

    Best on distinct titles (``match_titles``): texts are long, and most titles occur often.
    """

    def first(text: Column) -> Column:
        out = F.when(text == "", None)
        for role, name, confidence, alternatives in roles:
            keyword = F.coalesce(*(F.nullif(F.regexp_extract(text, f"(?i)({plain(x)})", 1), F.lit("")) for x in alternatives))
            out = out.when(text.rlike(pattern(alternatives)), F.struct(F.lit(role).alias("role_id"), F.lit(name).alias("role_name"), F.lit(confidence).alias("confidence"), keyword.alias("keyword")))
        return out

    text = neutral(F.coalesce(title, F.lit("")) if description is None else F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat_ws(" ", title, description)))
    return F.transform(F.array(text), first)[0]


def match_titles(postings: DataFrame, title: str = "title") -> DataFrame:
    """``postings`` with ``match``, computed once per distinct title: counted down first, matched, and joined back."""
    titles = postings.select(title).where(F.col(title).isNotNull()).distinct().withColumn("match", match(F.col(title)))
    return postings.join(titles, title, "left")


def confidence(n_results: Column, title: Column, top: Column) -> Column:
    """Of a lookup's best result, by the number of results and by how alike the titles are."""
    a, b = F.lower(title), F.lower(top)
    return F.when(top.isNull(), "low").when((n_results == 1) | a.contains(b) | b.contains(a), "high").when(n_results <= 5, "medium").otherwise("low")


def boosted(level: Column, code: Column, codes=PRIORITY_CODES) -> Column:
    return F.when((level == "medium") & code.isin(*codes), "high").otherwise(level)
