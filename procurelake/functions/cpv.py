"""Procurement vocabulary codes: the first code of a field, its division, sector and category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procurelake.functions.scalars import left_padded, trimmed

#: Divisions of the 2008 vocabulary.
DIVISIONS_2008 = {
    "03": "Agricultural, farming, fishing, forestry and related products",
    "09": "Petroleum products, fuel, electricity and other sources of energy",
    "14": "Mining, basic metals and related products",
    "15": "Food, beverages, tobacco and related products",
    "16": "Agricultural machinery",
    "18": "Clothing, footwear, luggage articles and accessories",
    "19": "Leather and textile fabrics, plastic and rubber materials",
    "22": "Printed matter and related products",
    "24": "Chemical products",
    "30": "Office and computing machinery, equipment and supplies except furniture and software packages",
    "31": "Electrical machinery, apparatus, equipment and consumables; lighting",
    "32": "Radio, television, communication, telecommunication and related equipment",
    "33": "Medical equipments, pharmaceuticals and personal care products",
    "34": "Transport equipment and auxiliary products to transportation",
    "35": "Security, fire-fighting, police and defence equipment",
    "37": "Musical instruments, sport goods, games, toys, handicraft, art materials and accessories",
    "38": "Laboratory, optical and precision equipments (excl. glasses)",
    "39": "Furniture (incl. office furniture), furnishings, domestic appliances (excl. lighting) and cleaning products",
    "41": "Collected and purified water",
    "42": "Industrial machinery",
    "43": "Machinery for mining, quarrying, construction equipment",
    "44": "Construction structures and materials; auxiliary products to construction (except electric apparatus)",
    "45": "Construction work",
    "48": "Software package and information systems",
    "50": "Repair and maintenance services",
    "51": "Installation services (except software)",
    "55": "Hotel, restaurant and retail trade services",
    "60": "Transport services (excl. Waste transport)",
    "63": "Supporting and auxiliary transport services; travel agencies services",
    "64": "Postal and telecommunications services",
    "65": "Public utilities",
    "66": "Financial and insurance services",
    "70": "Real estate services",
    "71": "Architectural, construction, engineering and inspection services",
    "72": "IT services: consulting, software development, Internet and support",
    "73": "Research and development services and related consultancy services",
    "75": "Administration, defence and social security services",
    "76": "Services related to the oil and gas industry",
    "77": "Agricultural, forestry, horticultural, aquacultural and apicultural services",
    "79": "Business services: law, marketing, consulting, recruitment, printing and security",
    "80": "Education and training services",
    "85": "Health and social work services",
    "90": "Sewage, refuse, cleaning and environmental services",
    "92": "Recreational, cultural and sporting services",
    "98": "Other community, social and personal services",
}
#: Divisions that only the 2003 vocabulary has.
DIVISIONS_2003 = {
    "01": "Agricultural, horticultural, hunting and related products",
    "02": "Forestry and logging products",
    "05": "Fish, fishing products and other by-products of the fishing industry",
    "10": "Coal, lignite, peat and other coal-related products",
    "11": "Petroleum, natural gas, oil and associated products",
    "12": "Uranium and thorium ores",
    "13": "Metal ores",
    "17": "Textiles and textile articles",
    "20": "Wood, wood products, cork products, basketware and wickerwork",
    "21": "Various types of pulp, paper and paper products",
    "23": "Petroleum products and fuels",
    "25": "Rubber, plastic and film products",
    "26": "Non-metallic mineral products",
    "27": "Basic metals and associated products",
    "28": "Fabricated products and materials",
    "29": "Machinery, equipment, appliances, apparatus and associated products",
    "36": "Manufactured goods, furniture, handicrafts, special-purpose products and associated consumables",
    "40": "Electricity, gas, nuclear energy and fuels, steam, hot water and other sources of energy",
    "52": "Retail trade services",
    "61": "Water transport services",
    "62": "Air transport services",
    "67": "Services auxiliary to financial intermediation",
    "74": "Architectural, engineering, construction, legal, accounting and other professional services",
    "78": "Printing, publishing, advertising and marketing services",
    "91": "Membership organisation services",
    "93": "Miscellaneous services",
    "95": "Private households with employed persons",
    "99": "Services provided by extra-territorial organisations and bodies",
}
#: Sectors and their divisions; all other divisions are REST.
SECTORS = {
    "Construction & engineering": ("45", "44", "43", "71"),
    "Transport & logistics": ("60", "61", "62", "63", "34", "64"),
    "Health, medical & pharma": ("33", "85", "24"),
    "ICT & professional services": ("48", "72", "73", "74", "79", "66", "67", "70", "75", "78"),
    "Environmental & facilities services": ("90", "50", "51", "65", "41"),
    "Food, hospitality & agriculture": ("15", "55", "52", "03", "77", "16", "01", "02", "05"),
    "Education, culture & other public services": ("80", "92", "98", "91", "93", "95", "99"),
}
REST = "Other manufacturing & goods"


def cleaned(c: Column) -> dict[str, Column]:
    """First code, division, division name, sector and category of a field of codes."""
    first = trimmed(F.regexp_replace(c, "[,;][\\s\\S]*", ""))
    code = left_padded(F.nullif(F.regexp_extract(first, "[0-9]+", 0), F.lit("")), 8)
    division = F.substring(code, 1, 2)
    names = F.create_map(*[F.lit(x) for kv in (DIVISIONS_2003 | DIVISIONS_2008).items() for x in kv])
    known = F.coalesce(*[F.when(division.isin(*ds), F.lit(s)) for s, ds in SECTORS.items()], F.lit(REST))
    category = F.when(division == "45", "Works").when(division.cast("int") >= 50, "Services").otherwise("Supplies")
    return {
        "cpv_code_first": code,
        "cpv_division": division,
        "cpv_division_name": F.try_element_at(names, division),
        "cpv_sector": F.when(division.isNotNull(), known),
        "cpv_category": F.when(division.isNotNull(), category),
    }
