"""Reference data of trade documents. The values below are fixed: names, codes and rates in the order that decides ties."""

from __future__ import annotations


PORTS = {
    "YANGZHOU": "CNYZH", "YANGZHOU, CHINA": "CNYZH", "ZHANGJIAGANG": "CNZJG", "ZHANGJIAGANG, CHINA": "CNZJG", "SHEKOU": "CNSHE", "DALIAN": "CNDLC",
    "DALIAN, CHINA": "CNDLC", "XIAMEN": "CNXMN", "XIAMEN, CHINA": "CNXMN", "YANTIAN": "CNYTN", "YANTIAN, CHINA": "CNYTN", "NANSHA": "CNNSA",
    "NANSHA, CHINA": "CNNSA", "HONG KONG": "HKHKG", "HONGKONG": "HKHKG", "NINGBO": "CNNBO", "NINGBO-ZHOUSHAN": "CNNBO", "SHANGHAI": "CNSHA",
    "SHANGHAI, CHINA": "CNSHA", "QINGDAO": "CNTAO", "QINGDAO, CHINA": "CNTAO", "TIANJIN": "CNTJN", "TIANJIN, CHINA": "CNTJN", "GUANGZHOU": "CNCAN",
    "GUANGZHOU, CHINA": "CNCAN", "HUANGPU": "CNCAN", "HUANGPU, CHINA": "CNCAN", "HUIZHOU": "CNHUI", "ZHONGSHAN": "CNZSN", "KEELUNG": "TWKEL",
    "KAOHSIUNG": "TWKHH", "TAIPEI": "TWTPE", "TOKYO": "JPTYO", "YOKOHAMA": "JPYOK", "OSAKA": "JPOSA", "NAGOYA": "JPNGO", "KOBE": "JPUBE", "HAKATA": "JPHKT",
    "BUSAN": "KRPUS", "BUSAN, KOREA": "KRPUS", "PUSAN": "KRPUS", "SEOUL": "KRINC", "INCHEON": "KRINC", "SINGAPORE": "SGSIN", "SINGAPORE, SINGAPORE": "SGSIN",
    "PORT KLANG": "MYPKG", "PENANG": "MYPEN", "LAHAD DATU": "MYLDU", "BINTULU": "MYBTU", "PASIR GUDANG": "MYPGU", "TANJUNG PELEPAS": "MYTPP",
    "HO CHI MINH": "VNSGN", "HO CHI MINH CITY": "VNSGN", "HOCHIMINH": "VNSGN", "SAIGON": "VNSGN", "HAIPHONG": "VNHPH", "HANOI": "VNHAN",
    "CANG CAT LAI": "VNSGN", "CANG TIEN SA": "VNUTH", "BANGKOK": "THBKK", "LAEM CHABANG": "THLCH", "KOTA KINABALU": "MYBKI", "KUCHING": "MYKCH",
    "BELAWAN": "IDBLW", "MEDAN": "IDBLW", "PANGKAL BALAM": "IDPBL", "PANGKAL PINANG": "IDPGK", "TANJUNG PRIOK": "IDTPP", "JAKARTA": "IDTPP",
    "JAKARTA, INDONESIA": "IDTPP", "SURABAYA": "IDSUB", "SURABAYA, INDONESIA": "IDSUB", "SEMARANG": "IDSEM", "MAKASSAR": "IDUPA", "CIKARANG": "IDCGK",
    "TANJUNG PERAK": "IDSUB", "JOMBANG": "IDSUB", "SYDNEY": "AUSYD", "MELBOURNE": "AUMEL", "BRISBANE": "AUBNE", "FREMANTLE": "AUFRE", "ROTTERDAM": "NLRTM",
    "ROTTERDAM, NETHERLANDS": "NLRTM", "ANTWERP": "BEANR", "HAMBURG": "DEHAM", "FELIXSTOWE": "GBFXT", "LE HAVRE": "FRLEH", "BARCELONA": "ESBCN",
    "PIRAEUS": "GRPIR", "LOS ANGELES": "USLAX", "LONG BEACH": "USLGB", "NEW YORK": "USNYC", "HOUSTON": "USHOU", "SAVANNAH": "USSAV", "VANCOUVER": "CAVAN",
    "MONTREAL": "CAMTQ", "SANTOS": "BRSSZ", "BUENOS AIRES": "ARBUE", "CALLAO": "PECLL", "DUBAI": "AEJEA", "SHARJAH": "AESHC", "JEBEL ALI": "AEJEA",
    "SALALAH": "OMSLL", "KUWAIT": "KUKWI", "DURBAN": "ZADUR", "CAPE TOWN": "ZACPT", "PORT ELIZABETH": "ZAPLZ", "MOMBASA": "KEMOM",
}
COUNTRIES = {
    "CHINA": "CN", "PEOPLES REPUBLIC OF CHINA": "CN", "PRC": "CN", "HONG KONG": "HK", "HONGKONG": "HK", "TAIWAN": "TW", "REPUBLIC OF CHINA": "TW",
    "JAPAN": "JP", "JAPAN, JAPAN": "JP", "SOUTH KOREA": "KR", "KOREA": "KR", "KOREA, REPUBLIC OF": "KR", "REPUBLIC OF KOREA": "KR", "DPRK": "KP",
    "NORTH KOREA": "KP", "INDONESIA": "ID", "SINGAPORE": "SG", "MALAYSIA": "MY", "THAILAND": "TH", "VIETNAM": "VN", "VIET NAM": "VN", "PHILIPPINES": "PH",
    "CAMBODIA": "KH", "MYANMAR": "MM", "LAOS": "LA", "BRUNEI": "BN", "TIMOR LESTE": "TL", "INDIA": "IN", "PAKISTAN": "PK", "BANGLADESH": "BD",
    "SRI LANKA": "LK", "NEPAL": "NP", "BHUTAN": "BT", "MALDIVES": "MV", "UNITED ARAB EMIRATES": "AE", "UAE": "AE", "SAUDI ARABIA": "SA", "QATAR": "QA",
    "KUWAIT": "KW", "BAHRAIN": "BH", "OMAN": "OM", "IRAN": "IR", "IRAQ": "IQ", "TURKEY": "TR", "ISRAEL": "IL", "LEBANON": "LB", "JORDAN": "JO",
    "GERMANY": "DE", "FRANCE": "FR", "UNITED KINGDOM": "GB", "UK": "GB", "ENGLAND": "GB", "ITALY": "IT", "SPAIN": "ES", "NETHERLANDS": "NL", "HOLLAND": "NL",
    "BELGIUM": "BE", "SWITZERLAND": "CH", "AUSTRIA": "AT", "SWEDEN": "SE", "NORWAY": "NO", "DENMARK": "DK", "FINLAND": "FI", "POLAND": "PL",
    "CZECH REPUBLIC": "CZ", "HUNGARY": "HU", "ROMANIA": "RO", "BULGARIA": "BG", "GREECE": "GR", "PORTUGAL": "PT", "IRELAND": "IE", "RUSSIA": "RU",
    "RUSSIAN FEDERATION": "RU", "UKRAINE": "UA", "BELARUS": "BY", "UNITED STATES": "US", "USA": "US", "UNITED STATES OF AMERICA": "US", "CANADA": "CA",
    "MEXICO": "MX", "BRAZIL": "BR", "ARGENTINA": "AR", "CHILE": "CL", "PERU": "PE", "COLOMBIA": "CO", "VENEZUELA": "VE", "ECUADOR": "EC", "SOUTH AFRICA": "ZA",
    "EGYPT": "EG", "MOROCCO": "MA", "TUNISIA": "TN", "ALGERIA": "DZ", "NIGERIA": "NG", "KENYA": "KE", "ETHIOPIA": "ET", "GHANA": "GH", "TANZANIA": "TZ",
    "UGANDA": "UG", "ANGOLA": "AO", "MOZAMBIQUE": "MZ", "ZAMBIA": "ZM", "ZIMBABWE": "ZW", "BOTSWANA": "BW", "NAMIBIA": "NA", "MAURITIUS": "MU",
    "MADAGASCAR": "MG", "AUSTRALIA": "AU", "NEW ZEALAND": "NZ", "PAPUA NEW GUINEA": "PG", "FIJI": "FJ", "UNKNOWN": "CN",
}
CURRENCIES = {
    "USD": "USD", "US$": "USD", "US DOLLAR": "USD", "DOLLAR": "USD", "US DOLLAR PER KG": "USD", "USD/KG": "USD", "US$ /KG": "USD", "CNY": "CNY", "RMB": "CNY",
    "YEN": "JPY", "YUAN": "CNY", "EURO": "EUR", "EUR": "EUR", "GBP": "GBP", "POUND": "GBP", "STERLING": "GBP", "JPY": "JPY", "SGD": "SGD",
    "SINGAPORE DOLLAR": "SGD", "MYR": "MYR", "MALAYSIAN RINGGIT": "MYR", "IDR": "IDR", "RUPIAH": "IDR", "THB": "THB", "BAHT": "THB", "KRW": "KRW",
    "WON": "KRW", "HKD": "HKD", "HONG KONG DOLLAR": "HKD", "AUD": "AUD", "AUSTRALIAN DOLLAR": "AUD", "NZD": "NZD", "INR": "INR", "RUPEE": "INR", "PHP": "PHP",
    "PESO": "PHP", "VND": "VND", "DONG": "VND",
}
INCOTERMS = { "EXW": "EXW", "FCA": "FCA", "FAS": "FAS", "FOB": "FOB", "CFR": "CFR", "CIF": "CIF", "CPT": "CPT", "CIP": "CIP", "DAP": "DAP", "DPU": "DPU", "DDP": "DDP", "DAT": "DAT",}
CIF_TERMS = ("CIF", "CIP", "CFR", "CPT")
PACKAGING = {
    "PIECE": "PCE", "PIECES": "PCE", "PC": "PCE", "PCS": "PCE", "UNIT": "PCE", "UNITS": "PCE", "EACH": "PCE", "SET": "SET", "SETS": "SET", "METER": "MTR",
    "METERS": "MTR", "MTR": "MTR", "MT": "TNE", "KILOGRAM": "KGM", "KILOGRAMS": "KGM", "KG": "KGM", "KGS": "KGM", "TONNE": "TNE", "TONNES": "TNE",
    "TON": "TNE", "LITER": "LTR", "LITERS": "LTR", "LITRE": "LTR", "LITRES": "LTR", "LT": "LTR", "CUBIC METER": "MTQ", "CUBIC METERS": "MTQ", "M3": "MTQ",
    "CBM": "MTQ", "ROLL": "ROL", "ROLLS": "ROL", "SPOOL": "ROL", "SPOOLS": "ROL", "REEL": "ROL", "REELS": "ROL", "CARTON": "CT", "CARTONS": "CT", "CTN": "CT",
    "BOX": "CT", "BOXES": "CT", "PACK": "CT", "PACKS": "CT", "PALLET": "TDP", "PALLETS": "TDP", "FLAT PALLET": "TDP", "DRUM": "DRM", "DRUMS": "DRM",
    "BARREL": "DRM", "BARRELS": "DRM", "STEEL DRUM": "DRM", "BAG": "BAG", "BAGS": "BAG", "SACK": "BAG", "SACKS": "BAG", "BIG BAG": "BAG", "BIGBAG": "BAG",
    "JUMBO BAG": "BAG", "CRATE": "CRD", "CRATES": "CRD", "20FT": "20", "40FT": "40", "40HQ": "40", "45FT": "45", "ISO TANK": "TANK",
}
PARTIES = {
    "buyer": "1", "importer": "1", "penerima": "1", "seller": "9", "exporter": "9", "pengirim": "9", "manufacturer": "10", "produsen": "10", "pabrik": "10",
    "shipper": "7", "pengirim_barang": "7", "notify": "4", "notify_party": "4", "notifyparty": "4", "consignee": "11", "tujuan_kirim": "11",
}
#: Duty by chapter of the tariff.
CHAPTERS = {
    "50": 5.0, "51": 5.0, "52": 5.0, "53": 5.0, "54": 5.0, "55": 5.0, "56": 5.0, "57": 5.0, "58": 5.0, "59": 5.0, "60": 5.0, "40": 5.0, "72": 5.0, "73": 5.0,
    "74": 5.0, "75": 5.0, "76": 5.0, "78": 5.0, "79": 5.0, "80": 5.0, "81": 5.0, "83": 5.0, "28": 5.0, "29": 5.0, "30": 5.0, "31": 5.0, "32": 5.0, "33": 5.0,
    "34": 5.0, "35": 5.0, "36": 5.0, "37": 5.0, "38": 5.0, "39": 5.0, "47": 5.0, "48": 5.0, "49": 5.0, "41": 5.0, "43": 5.0, "44": 5.0, "45": 5.0, "46": 5.0,
    "68": 5.0, "69": 5.0, "70": 5.0, "71": 5.0, "91": 5.0, "92": 5.0, "93": 5.0, "61": 10.0, "62": 10.0, "63": 10.0, "42": 10.0, "64": 10.0, "65": 10.0,
    "66": 10.0, "67": 10.0, "94": 10.0, "95": 10.0, "96": 10.0, "84": 0.0, "85": 0.0, "87": 0.0, "90": 0.0, "97": 0.0,
}
CHAPTER_DEFAULT, CHAPTER_FACILITY = 5.0, "3"
#: Codes of the tariff map in order; duty is 0, VAT 12 and income tax 2.5 but for those below.
TARIFF = (
    "84152090", "39169092", "87169099", "35069190", "82041100", "39173129", "59061000", "84836000", "39174000", "39173299", "83079000", "84678900", "32141000",
    "84137099", "40092210", "40169190", "85452000", "90173000", "68129990", "84679990", "82052000", "40103100", "84672200", "82029100", "84242029", "84139190",
    "84248990", "84135090", "87168090", "40169999", "85044090", "85365039", "85361099", "85177999", "94032090", "85153990", "84688000", "85444299", "84145999",
    "90261050", "90303390", "85364199", "84671900", "76169990", "85446039", "90262090", "85159090", "83022090", "82042000", "82079000", "82034000", "82051000",
    "82075000", "82074000", "84239040", "84254290", "84798970", "82029910", "70199090", "82082000", "84132090", "85366929", "90158090", "90314930", "85123099",
    "85122099", "85076090",
)
TARIFF_DUTY = {"84152090": 10.0, "39173129": 5.0, "39173299": 5.0, "84137099": 2.5}
TARIFF_INCOME = {"84152090": 10.0}
TARIFF_DEFAULT = (0.0, 12.0, 2.5)
FX = {"USD": 15450.0, "CNY": 2640.0, "EUR": 16800.0, "GBP": 19500.0, "JPY": 105.0, "SGD": 11400.0, "MYR": 3450.0, "KRW": 11.0, "HKD": 1970.0, "AUD": 10200.0, "THB": 440.0, "IDR": 1.0}
FREIGHT = {"20": 800.0, "40": 1400.0, "40HQ": 1500.0, "45": 1600.0, "TANK": 2500.0, "LCL": 50.0}
INSURANCE = (0.005, 20.0, 500.0)
VAT = 0.11
WEIGHTS = {
    "KG": 1.0, "KGM": 1.0, "KILOGRAM": 1.0, "KILOGRAMS": 1.0, "LB": 0.453592, "LBS": 0.453592, "POUND": 0.453592, "POUNDS": 0.453592, "TON": 1000.0,
    "TONNE": 1000.0, "TONNES": 1000.0, "TNE": 1000.0, "MT": 1000.0, "LIANG": 0.0375, "TAEL": 0.0375, "CATTY": 0.5, "KIN": 0.5, "G": 0.001, "GR": 0.001,
    "GRAM": 0.001, "GRAMS": 0.001,
}


#: Kinds of declaration by the code in a declaration number.
DOCUMENT_CODES = ("01", "11", "12", "15", "23", "25", "27")
#: Fixed value: what follows the name of a port and isn't part of it.
PORT_COUNTRY = r"[,\-\s]*(CHINA|INDONESIA|KOREA|JAPAN|SINGAPORE|THAILAND|MALAYSIA|VIETNAM).*$"
#: Labels for which a pattern's value goes before the layout's, and those of them whose format is checked.
PATTERN_LABELS = (
    "incoterms", "item_code", "item_hs_code", "item_quantity", "item_unit_price", "item_amount", "total_amount", "total_quantity", "total_net_weight",
    "total_gross_weight", "net_weight_per_item", "gross_weight_per_item", "cbm", "total_cbm", "measurement", "container_number", "seal_number",
    "number_of_packages", "number_of_cartons",
)
STRICT_LABELS = ("item_hs_code", "item_code", "container_number")
CURRENCY_CODES = ("USD", "CNY", "EUR", "GBP", "JPY", "SGD", "IDR", "AUD", "KRW")
#: Patterns of header fields, in the order tried; those marked False heed the case of letters.
ENTITY_PATTERNS = {
    "invoice_number": ((r"C/I\s*NO[:\s]*([A-Z0-9][-A-Z0-9/]{3,40})", True), (r"(?:Invoice\s*(?:No\.?|Number|#)\s*[:\s]*)([A-Z0-9][-A-Z0-9/]{3,30})", True), (r"INV[:\s#]*([A-Z0-9][-A-Z0-9/]{3,30})", True)),
    "invoice_date": ((r"DATE[:\s]*([A-Z][a-z]{2,3}\.?[\sd]*\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4})", True), (r"DATE[:\s]*(\d{1,2}[\s.-](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s,.-]*\d{2,4})", True)),
    "currency": ((r"(?:Currency|Valuta)[:\s]*(USD|CNY|EUR|GBP|JPY|SGD|IDR|AUD|KRW)", True), (r"\b(CNY|USD|EUR|GBP|JPY|SGD|IDR|AUD|KRW)\b", False)),
    "incoterms": ((r"\b(FOB|CIF|CFR|EXW|DAP|DDP|FCA|CPT|CIP|FAS|DAT)\b", True),),
    "container_number": ((r"\b([A-Z]{4}\d{7})\b", False), (r"Container\s*(?:No\.?|Number)?[:\s]*([A-Z0-9]{4,20})", True)),
    "bl_number": ((r"Reference\s*(?:No\.?|#)\s*([A-Z0-9]{8,20})", True), (r"BL\s*(?:No\.?|Number)[:\s]*([A-Z0-9]{5,30})", True), (r"(?:Bill\s+of\s+Lading|B/L)[:\s#]*([A-Z0-9]{5,30})", True)),
    "vessel_name": ((r"(?:Vessel(?:'s)?\s+name|STEAMSHIP|M/V\s*|MV\s*|M/S\s*)[:\s]*([A-Z][A-Z\s]{2,35})", True), (r"\b([A-Z][A-Z\s]{3,35})\s+(\d{2,4}[A-Z])\b", False)),
    "port_of_loading": ((r"(?:Port\s+(?:of\s+)?(?:Load|Origin)|From\s+)[:\s]*([A-Z][A-Z\s]{2,25}(?:,?\s*[A-Z]{2,10})?)", True), (r"(?:PORT\s+OF\s+LOADING)[:\s]*([A-Z][A-Z\s]{2,25})", True)),
    "port_of_discharge": ((r"(?:Port\s+(?:of\s+)?(?:Discharge|Dest|Delivery)|To\s+)[:\s]*([A-Z][A-Z\s]{2,25}(?:,?\s*[A-Z]{2,10})?)", True), (r"(?:PORT\s+OF\s+(?:DISCHARGE|DESTINATION))[:\s]*([A-Z][A-Z\s]{2,25})", True)),
    "gross_weight": ((r"(?:Gross\s*(?:Weight|Wt)|G\.?W\.?)[:\s]*([\d,]+\.?\d*)\s*(?:KGS?|KG|LBS?)?", True), (r"(?:TOTAL\s+)?G\.?W\.?[:\s]*([\d,]+\.?\d*)", True)),
    "net_weight": ((r"(?:Net\s*(?:Weight|Wt)|N\.?W\.?)[:\s]*([\d,]+\.?\d*)\s*(?:KGS?|KG|LBS?)?", True), (r"(?:TOTAL\s+)?N\.?W\.?[:\s]*([\d,]+\.?\d*)", True)),
    "country_of_origin": ((r"(?:Country\s+(?:of\s+)?Origin|Manufactured\s+in|Made\s+in)[:\s]*([A-Z][A-Z\s]{2,20})", True), (r"\bCHINA\b", False)),
    "number_of_packages": ((r"(\d+)\s*(?:CARTONS?|CARTON|CTN|PK|PCS|PC|UNT|CASES?)", True), (r"(?:Total\s+)?(?:Cartons?|Packages?|Boxes?|Cases?|CTN|PK)[:\s]*(\d+)", True)),
    "freight_term": ((r"(?:Freight|FRT|Payload)[:\s]*(Prepaid|Collect|Prepaid\s*&\s*Collect)", True),),
    "cbm": ((r"(?:CBM|Volume)[:\s]*([\d,]+\.\d{1,4})", True), (r"\b(\d+\.\d{1,4})\s*(?:CBM|m3)", True)),
}
#: Words that are no value of a header field.
GARBAGE = ("DATE", "CODE", "DESCRIPTION", "MATERIAL", "NUMBER", "TERM", "PRICE", "QUANTITY", "TOTAL", "AMOUNT", "SERVICE", "CONTRACT", "NAME", "TRADE", "PRODUCT")
#: Ports looked for by name, in order; those of DISCHARGE are where goods arrive.
PORT_KEYWORDS = {
    "YANGZHOU": "CNYZH", "NINGBO": "CNNGB", "SHANGHAI": "CNSHA", "GUANGZHOU": "CNCAN", "QINGDAO": "CNTAO", "TIANJIN": "CNTJN", "XIAMEN": "CNXMN", "YANTIAN": "CNYTN", "BEIJING": "CNBJS",
    "HUANGPU": "CNHHP", "JAKARTA": "IDTPP", "SURABAYA": "IDSUB", "SEMARANG": "IDSEM", "BELAWAN": "IDBLW", "TANJUNG PRIOK": "IDTPP", "TANJUNG PERAK": "IDTPS", "PANGKAL BALIK": "IDTJS",
}
DISCHARGE = ("JAKARTA", "SURABAYA", "BELAWAN")
#: Misread endings and beginnings of item codes, in the order they are mended.
CODE_FIXES = (("-WHITH$", "-WHITE"), ("-WHITI$", "-WHITE"), ("-WHITEI$", "-WHITE"), ("-WHIT$", "-WHITE"), ("^ID-", "HD-"))
#: What is no item code as a whole, and words that no item code holds.
NO_CODE = r"^(C/I|CO\.|LTD|INC|LLC|CORP|NO|NPWP|KODE|TELP|COMMERCIAL|UNIT|FROM|TO|PORT|VESSEL|VOYAGE|BL|DATE|FREIGHT|TOTAL|ORIGIN|BENEFICIARY|ADDRESS|TEL|FAX|EMAIL|BUYER|SELLER|INVOICE)$"
NO_CODE_WORDS = (
    "FILING", "CABINET", "BLACK", "AND", "WHITE", "FURNITURE", "SET", "TABLE", "CHAIR", "DESK", "STORAGE", "RACK", "SHELF", "OFFICE", "NUMBER", "CODE", "PRODUCT", "TRADE", "NAME", "PORT",
    "DISCHARGE", "TERM", "PRICE", "UNIT", "QUANTITY", "TOTAL", "AMOUNT", "TEXTILE", "CORD", "POLYESTER", "NYLON", "YARN", "FABRIC", "WOVEN", "KNITTED", "HDSP", "DSP", "HD", "EPI", "D/2", "KGS",
    "KG", "METER", "METRE", "SYNTHETIC", "RUBBER", "STEEL", "PLATE", "CABIN", "COVER", "LAMP", "ASSEMBLY", "PANEL", "CONTROL", "WINDOW", "WINE", "HARNESS", "CAPILLARY", "CONDENSER", "HVAC",
    "VENTILATION", "TEMPERATURE", "LOWER", "HINGE", "ADJUST", "FEET", "ROLLER", "MOTOR", "PUMP", "VALVE", "BEARING", "REFINED", "SUGAR", "REFILL", "PACK", "CARTON", "PALLET", "BUNDLE", "PIECE",
    "WHOLE", "HALF", "LARGE", "SMALL", "MEDIUM",
)
#: What is no code of a packing list, and how its codes begin.
NO_LIST_CODE = r"^(C/I|CO\.|LTD|INC|LLC|CORP|NO|NPWP|KODE|TELP|PACKING|ID|HENAN|PRODUCTS|SHIPPER|CONSIGNEE|PERGUDANGAN|FROM|TO|PORT|VESSEL|VOYAGE|BL|JUL|DATE|LUOYANG|CNAPS|SWIFT|FREIGHT|TOTAL|CIKOKOL|MH|THAMRIN|CHINA|INDONESIA|ORIGIN|NPWP|FILING|CABINET|CARTONS|CBM|MEASUREMENT|YJ\d|TLLU|UETU|TELU|CN|GLN|BENEFICIARY)$"
LIST_CODES = ("HD-", "TB-", "DQ-", "CZ-", "MM-", "DTGYG-")
LIST_ID_CODES = ("ID-HD-SLD-", "ID-SLD-")
#: Lines that hold no item.
SKIPPED_LINES = (r"^(?:JL\.?|KENARI|RAYA|BLOK)\s", r"^\d{2}[.-]\d{2}[.-]\d{2,}", r"^\d{3}[.-]\d{3}[.-]\d{3}", r"(?:TELEGRAM|FAX|TEL\.?|PHONE|EMAIL|WEBSITE|HTTP)", r"(?:TAX\s*ID|NPWP|IDENTITY|Nomor\s+ID)", r"^(?:INDONESIA|CHINA|SINGAPORE|MALAYSIA|THAILAND)$")
#: What a file's name must hold to be of a kind, in the order tried.
FILE_KINDS = {"ci": ("ci", "invoice", "inv_", "inv-", "smu"), "pl": ("pl", "packing", "pk"), "bl": ("bl", "lading", "hbl", "mbl", "awb"), "xlsx": (".xlsx", ".xls"), "unknown_pdf": (".pdf",)}
#: Header fields that count for completeness, and those that a declaration must have.
HEADER_FIELDS = ("invoice_number", "invoice_date", "bl_number", "bl_date", "currency", "incoterms", "total_amount", "port_of_loading", "port_of_discharge", "vessel_name", "voyage_number", "seller_name", "buyer_name")
REQUIRED_FIELDS = ("invoice_number", "invoice_date", "currency", "incoterms", "total_amount", "port_of_loading", "port_of_discharge", "vessel_name", "seller_name", "buyer_name")
#: Numbers of the months by the first three letters of their names.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def values(rows) -> str:
    """Rows as the body of a SQL VALUES list."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def keyed(dim: dict[str, object]) -> list[tuple]:
    return [(k, v, i) for i, (k, v) in enumerate(dim.items())]


def tariff_rows() -> list[tuple]:
    d, v, p = TARIFF_DEFAULT
    return [(int(c), int(c) // 10000, TARIFF_DUTY.get(c, d), v, TARIFF_INCOME.get(c, p), i) for i, c in enumerate(TARIFF)]


#: Terms, ports, countries, units and packaging by which values are normalised, in the order in which they are looked up.
NORMAL_TERMS = ("FOB", "CIF", "CFR", "EXW", "DAP", "DDP", "FCA", "CPT", "CIP", "FAS", "DAT")
NORMAL_PORTS = {
    "SHANGHAI": "CNSHA", "NINGBO": "CNNBO", "YANTIAN": "CNYTN", "GUANGZHOU": "CNCAN", "HONGKONG": "HKHKG", "SINGAPORE": "SGSIN", "NANSHA": "CNNSA", "KAOHSIUNG": "TWKHH", "BUSAN": "KRPUS",
    "QINGDAO": "CNTAO", "TIANJIN": "CNTJN", "DALIAN": "CNDLC", "XIAMEN": "CNXMN", "SHENZHEN": "CNSZN", "JAKARTA": "IDTPP", "SEMARANG": "IDSUB", "SURABAYA": "IDSUB", "BELAWAN": "IDBLW",
    "TANJUNG PRIOK": "IDTPP", "CIKARANG": "IDCGK",
}
NORMAL_COUNTRIES = {
    "CHINA": "CN", "INDONESIA": "ID", "SINGAPORE": "SG", "MALAYSIA": "MY", "THAILAND": "TH", "JAPAN": "JP", "KOREA": "KR", "HONG KONG": "HK", "TAIWAN": "TW", "VIETNAM": "VN", "INDIA": "IN",
    "USA": "US", "U.S.A.": "US", "GERMANY": "DE", "UNITED KINGDOM": "GB", "AUSTRALIA": "AU",
}
NORMAL_UNITS = {
    "PCS": "PCE", "PC": "PCE", "PIECES": "PCE", "PIECE": "PCE", "SET": "SET", "SETS": "SET", "MTR": "MTR", "METER": "MTR", "METERS": "MTR", "KG": "KGM", "KILOGRAM": "KGM", "KILOGRAMS": "KGM",
    "MT": "TNE", "TON": "TNE", "TONNE": "TNE", "CTN": "CT", "CARTON": "CT", "CARTONS": "CT", "PK": "PK", "PACK": "PK", "PACKAGE": "PK",
}
NORMAL_PACKAGING = {
    "CTN": "CT", "CARTON": "CT", "CARTONS": "CT", "PK": "PK", "PACKAGE": "PK", "PALLET": "PLT", "CASE": "CS", "CRATE": "CR", "DRUM": "DM", "BAG": "BG", "BARREL": "BR", "BOX": "BX",
}
