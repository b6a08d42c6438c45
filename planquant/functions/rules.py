"""Fixed values of the take-off domain: word lists, limits, sizes, patterns, prices.

These must be exactly these for results to be right; they are stated as they are, in their natural order.
"""

from __future__ import annotations

# OCR misreadings and what they stand for, in order of application. Rules that replace a word by itself are left out.
OCR_FIXES: tuple[tuple[str, str], ...] = (
    (r"\bTIPE\b", "TYPE"),
    (r"\bTYPF\b", "TYPE"),
    (r"\bTYP[E3]\b", "TYPE"),
    (r"\b7YPE\b", "TYPE"),
    (r"\bTYPE\s+C\b", "TYPE C"),
    (r"\bTYPE\s+D\b", "TYPE D"),
    (r"\bTYPE\s+E\b", "TYPE E"),
    (r"\bTYPE\s+P\b", "TYPE P"),
    (r"\bTYPE\s+7\b", "TYPE 7"),
    (r"\bINIET\b", "INLET"),
    (r"\bINLFT\b", "INLET"),
    (r"\bINL[E3]T\b", "INLET"),
    (r"\bN[I1]LET\b", "INLET"),
    (r"\bNLET\b", "INLET"),
    (r"\b1NLET\b", "INLET"),
    (r"\bINLE7\b", "INLET"),
    (r"\bLNLET\b", "INLET"),
    (r"\bMANHOI[E3]\b", "MANHOLE"),
    (r"\bMANH0LE\b", "MANHOLE"),
    (r"\bM\.H\.\b", "MH"),
    (r"\bJUNCT[I1]ON\b", "JUNCTION"),
    (r"\bJUNCTION\s+BOX\b", "JUNCTION BOX"),
    (r"\bJ\.B\.\b", "JB"),
    (r"\bROP\b", "RCP"),
    (r"\bR[C0]P\b", "RCP"),
    (r"\bRGP\b", "RCP"),
    (r"\bR\.C\.P\.\b", "RCP"),
    (r"\bH[O0]PE\b", "HDPE"),
    (r"\bHOPE\b", "HDPE"),
    (r"\bH\.D\.P\.E\.\b", "HDPE"),
    (r"\bPV[C0]\b", "PVC"),
    (r"\bP\.V\.C\.\b", "PVC"),
    (r"\bD[I1]P\b", "DIP"),
    (r"\bD\.I\.P\.\b", "DIP"),
    (r"\bC\.M\.P\.\b", "CMP"),
    (r"\bENDWAIL\b", "ENDWALL"),
    (r"\bENDWAL[I1L]\b", "ENDWALL"),
    (r"\bEND\s*WALL\b", "ENDWALL"),
    (r"\bE\.W\.\b", "ENDWALL"),
    (r"\bMITURED\b", "MITERED"),
    (r"\bM[I1]TERED\b", "MITERED"),
    (r"\bM[I1]TRED\b", "MITERED"),
    (r"\bSECT[I1]ON\b", "SECTION"),
    (r"\bSECTIONF\b", "SECTION"),
    (r"\bSEC7ION\b", "SECTION"),
    (r"\bM[E3]S\b", "MES"),
    (r"\bF\.E\.S\.\b", "FES"),
    (r"\bHEADWAIL\b", "HEADWALL"),
    (r"\bAPR0N\b", "APRON"),
    (r"\bGRA7E\b", "GRATE"),
    (r"\bI[F1]\b", "LF"),
    (r"\b[I1]F\b", "LF"),
    (r"\bL\.F\.\b", "LF"),
    (r"\bLIN\s*FT\b", "LF"),
    (r"\bE[A4]\b", "EA"),
    (r"\bS\.Y\.\b", "SY"),
    (r"\bC\.Y\.\b", "CY"),
    (r"\bS\.F\.\b", "SF"),
    (r"\bTONS\b", "TON"),
    (r"\bL\.S\.\b", "LS"),
    (r'\b(\d+)["\s]*[I1]NCH\b', "$1 INCH"),
    (r'\b(\d+)["\s]*IN\b', "$1 IN"),
    (r"\bD[I1]AMETER\b", "DIAMETER"),
    (r"\bD[I1]A\b", "DIA"),
    (r"\bRAD[I1]US\b", "RADIUS"),
    (r"\bPEOROS[E3]D\b", "PROPOSED"),
    (r"\bPROPOS[E3]D\b", "PROPOSED"),
    (r"\bPR0POSED\b", "PROPOSED"),
    (r"\bUTUTY\b", "UTILITY"),
    (r"\bUT[I1]L[I1]TY\b", "UTILITY"),
    (r"\bEX[I1]ST[I1]NG\b", "EXISTING"),
    (r"\bEXSOVENT\b", "EXISTING"),
    (r"\bEX\.\b", "EXIST"),
    (r"\bCONDU[I1]T\b", "CONDUIT"),
    (r"\bC0NDUIT\b", "CONDUIT"),
    (r"\bDRA[I1]NAGE\b", "DRAINAGE"),
    (r"\bDRA1NAGE\b", "DRAINAGE"),
    (r"\bSTRUCTUR[E3]\b", "STRUCTURE"),
    (r"\bCONCR[E3]T[E3]\b", "CONCRETE"),
    (r"\bR[E3][I1]NFORC[E3]D\b", "REINFORCED"),
    (r"\bGALVAN[I1]Z[E3]D\b", "GALVANIZED"),
    (r"\bST[E3][E3]L\b", "STEEL"),
    (r"\bALUM[I1]NUM\b", "ALUMINUM"),
    (r"\bENO\b", "END"),
    (r"\bW[I1]NGED\b", "WINGED"),
    (r"\bSTRA[I1]GHT\b", "STRAIGHT"),
    (r"\bBARR[E3]L\b", "BARREL"),
    (r"\bS[I1]NGLE\b", "SINGLE"),
    (r"\bDOUBL[E3]\b", "DOUBLE"),
    (r"\bTR[I1]PLE\b", "TRIPLE"),
    (r"\bC[L1]ASS\b", "CLASS"),
    (r"\bGRAD[E3]\b", "GRADE"),
    (r"\bEL\.\b", "EL"),
    (r"\b[I1]NV\b", "INV"),
    (r"\bT\.C\.\b", "TC"),
    (r"\bR[I1]M\b", "RIM"),
    (r"\bF\.L\.\b", "FL"),
    (r"\bSL0PE\b", "SLOPE"),
    (r"\bSTA\.\b", "STA"),
    (r"\b0FFSET\b", "OFFSET"),
    (r"\bC\.L\.\b", "CL"),
    (r"\bFD0T\b", "FDOT"),
    (r"\bPAY\s*[I1]TEM\b", "PAY ITEM"),
    (r"\bQUANT[I1]TY\b", "QUANTITY"),
    (r"\bUN[I1]T\b", "UNIT"),
    (r"\bDESCR[I1]PT[I1]ON\b", "DESCRIPTION"),
    (r"\bSPEC[I1]F[I1]CAT[I1]ON\b", "SPECIFICATION"),
    (r"\bSH[E3]ET\b", "SHEET"),
    (r"\bPROF[I1]LE\b", "PROFILE"),
    (r"\bD[E3]TAIL\b", "DETAIL"),
    (r"\bSCAL[E3]\b", "SCALE"),
    (r"\b0\b(?=[A-Z])", "O"),
    ("(?<=[A-Z])0(?=[A-Z])", "O"),
    (r"\b1\b(?=[A-Z])", "I"),
    ("(?<=[A-Z])1(?=[A-Z])", "I"),
)
# Ways to write a size.
SIZE_FIXES: tuple[tuple[str, str], ...] = (
    (r'(\d{1,2})\s*["\u201d\u2033]?\s*(RCP|HDPE|PVC|DIP|PIPE)', '$1" $2'),
    (r"(\d{1,2})\s*-?\s*INCH", '$1"'),
    (r"(\d{1,2})\s+IN\b", '$1"'),
)

# Words by which a page is classified.
SUMMARY_WORDS = ('summary of quantities', 'summary of pay items', 'tabulation of quantities', 'estimate of quantities', 'pay item summary', 'bid schedule', "engineer's estimate", 'quantity summary', 'pay item no', 'fdot item', 'grand total', 'total this sheet')
TITLE_WORDS = ('project', 'plans for', 'prepared for', 'prepared by', 'cover sheet', 'title sheet', 'drawing index', 'engineer of record', 'contractor', 'owner', 'construction plans', 'improvement plans')
TOC_WORDS = ('table of contents', 'sheet index', 'drawing list', 'sheet no', 'sheet number', 'index of drawings', 'list of sheets', 'drawing index')
NOTES_WORDS = ('general notes', 'legend', 'abbreviations', 'symbols', 'standard notes', 'specifications', 'notes:', 'typical sections', 'detail sheet')
PAYLOAD_WORDS = ('pipe', 'rcp', 'pvc', 'hdpe', 'culvert', 'manhole', 'inlet', 'catch basin', 'structure', 'storm drain', 'drainage', 'sanitary', 'lf', 'ea', 'sy', 'cy', 'ls')

# Phrases of summary sheets.
SUMMARY_PRIMARY = ('SUMMARY OF QUANTITIES', 'SUMMARY OF PAY ITEMS', 'TABULATION OF QUANTITIES', 'ESTIMATE OF QUANTITIES', 'PAY ITEM SUMMARY', 'BID SCHEDULE', "ENGINEER'S ESTIMATE", 'SUMMARY OF ESTIMATED QUANTITIES')
SUMMARY_SECONDARY = ('QUANTITY SUMMARY', 'BID ITEM', 'PAY ITEM NO', 'FDOT ITEM', 'ITEM DESCRIPTION', 'GRAND TOTAL', 'TOTAL THIS SHEET')

# Quantity limits by unit (minimum, maximum, typical maximum).
QUANTITY_LIMITS = {
    "LF": (0, 10000, 5000),
    "EA": (0, 200, 50),
    "SY": (0, 100000, 50000),
    "SF": (0, 100000, 50000),
    "CY": (0, 50000, 10000),
    "TON": (0, 100000, 10000),
    "GAL": (0, 100000, 10000),
    "AC": (0, 1000, 100),
    "LS": (1, 1, 1),
}
ROUND_QUANTITIES = (100, 200, 250, 500, 1000, 1500, 2000, 2500, 3000, 5000, 10000)

# Catalog sizes in inches, round and elliptical (rise, span).
PIPE_SIZES = (12, 15, 18, 24, 30, 36, 42, 48, 54, 60, 66, 72, 84, 96)
ELLIPTICAL_SIZES = ((12, 18), (14, 23), (19, 30), (24, 38), (29, 45), (34, 53), (38, 60), (43, 68), (48, 76), (53, 83), (58, 91))
MAX_PIPE_SIZE = 96

# Liners that are no pipes.
MEMBRANE_WORDS = ('FABRIC', 'FLEXIBLE', 'GEOMEMBRANE', 'GEOTEXTILE', 'LINER', 'MEMBRANE', 'SHEET', 'WATERPROOFING')
MEMBRANE_MILS = (20, 30, 40, 60, 80, 100)
NON_PIPE_PREFIXES = ("900-", "570-")

# Price sanity.
MAX_LINE_COST = 1_000_000
MAX_UNIT_PRICE = {"LF": 1_000, "EA": 100_000, "SY": 500, "SF": 500}
MIN_UNIT_PRICE = 0.01
MIN_DESCRIPTION = 3

# Structure codes (code, type, subtype, price, depth).
STRUCTURES: tuple[tuple[str, str, str, float, str], ...] = (
    ("425-1-101", "INLET", "CURB TYPE A", 3200.0, "<4'"),
    ("425-1-102", "INLET", "CURB TYPE A", 3800.0, "4'-6'"),
    ("425-1-103", "INLET", "CURB TYPE A", 4500.0, "6'-8'"),
    ("425-1-201", "INLET", "CURB TYPE B", 3500.0, "<4'"),
    ("425-1-202", "INLET", "CURB TYPE B", 4200.0, "4'-6'"),
    ("425-1-203", "INLET", "CURB TYPE B", 5000.0, "6'-8'"),
    ("425-1-521", "INLET", "DITCH BOTTOM TYPE C", 4200.0, "<4'"),
    ("425-1-522", "INLET", "DITCH BOTTOM TYPE C", 4800.0, "4'-6'"),
    ("425-1-523", "INLET", "DITCH BOTTOM TYPE C", 5500.0, "6'-8'"),
    ("425-1-541", "INLET", "DITCH BOTTOM TYPE C", 4200.0, "Standard"),
    ("425-1-531", "INLET", "DITCH BOTTOM TYPE D", 4800.0, "<4'"),
    ("425-1-532", "INLET", "DITCH BOTTOM TYPE D", 5500.0, "4'-6'"),
    ("425-1-533", "INLET", "DITCH BOTTOM TYPE D", 6200.0, "6'-8'"),
    ("425-1-549", "INLET", "DITCH BOTTOM TYPE D MODIFIED", 5800.0, "Standard"),
    ("425-1-551", "INLET", "DITCH BOTTOM TYPE E", 4000.0, "<4'"),
    ("425-1-552", "INLET", "DITCH BOTTOM TYPE E", 4600.0, "4'-6'"),
    ("425-1-553", "INLET", "DITCH BOTTOM TYPE E", 5200.0, "6'-8'"),
    ("425-1-561", "INLET", "DITCH BOTTOM TYPE H", 5500.0, "<4'"),
    ("425-1-562", "INLET", "DITCH BOTTOM TYPE H", 6200.0, "4'-6'"),
    ("425-1-563", "INLET", "DITCH BOTTOM TYPE H", 7000.0, "6'-8'"),
    ("425-1-571", "INLET", "DITCH BOTTOM TYPE J", 5200.0, "<4'"),
    ("425-1-572", "INLET", "DITCH BOTTOM TYPE J", 5900.0, "4'-6'"),
    ("425-1-573", "INLET", "DITCH BOTTOM TYPE J", 6600.0, "6'-8'"),
    ("425-1-601", "INLET", "CURB TYPE P", 6500.0, "<6'"),
    ("425-1-602", "INLET", "CURB TYPE P", 7500.0, "6'-8'"),
    ("425-1-603", "INLET", "CURB TYPE P", 8500.0, "8'-10'"),
    ("425-1-604", "INLET", "CURB TYPE P", 9500.0, ">10'"),
    ("425-1-621", "INLET", "CURB TYPE P-5", 7200.0, "Standard"),
    ("425-1-631", "INLET", "CURB TYPE P-6", 8800.0, "Standard"),
    ("425-1-901", "INLET", "CURB TYPE 9", 5500.0, "<6'"),
    ("425-1-902", "INLET", "CURB TYPE 9", 6500.0, "6'-8'"),
    ("425-1-903", "INLET", "CURB TYPE 9", 7500.0, "8'-10'"),
    ("425-1-701", "INLET", "SLOTTED TYPE S", 4800.0, "<4'"),
    ("425-1-702", "INLET", "SLOTTED TYPE S", 5500.0, "4'-6'"),
    ("425-1-751", "INLET", "VALLEY GUTTER TYPE V", 4200.0, "<4'"),
    ("425-1-752", "INLET", "VALLEY GUTTER TYPE V", 4900.0, "4'-6'"),
    ("425-2-31", "MANHOLE", "TYPE J", 4500.0, "<4'"),
    ("425-2-32", "MANHOLE", "TYPE J", 5200.0, "4'-6'"),
    ("425-2-33", "MANHOLE", "TYPE J", 6000.0, "6'-8'"),
    ("425-2-34", "MANHOLE", "TYPE J", 6800.0, "8'-10'"),
    ("425-2-41", "MANHOLE", "TYPE 7", 5500.0, "Standard"),
    ("425-2-71", "MANHOLE", "TYPE P", 5500.0, "<6'"),
    ("425-2-72", "MANHOLE", "TYPE P", 6500.0, "6'-8'"),
    ("425-2-73", "MANHOLE", "TYPE P", 7500.0, "8'-10'"),
    ("425-2-74", "MANHOLE", "TYPE P", 8500.0, ">10'"),
    ("425-2-81", "MANHOLE", "TYPE P-7", 6200.0, "Standard"),
    ("425-3-11", "JUNCTION_BOX", "STANDARD", 3800.0, "<4'"),
    ("425-3-12", "JUNCTION_BOX", "STANDARD", 4500.0, "4'-6'"),
    ("425-3-13", "JUNCTION_BOX", "STANDARD", 5200.0, "6'-8'"),
    ("425-4-11", "CATCH_BASIN", "STANDARD", 3500.0, "<4'"),
    ("425-4-12", "CATCH_BASIN", "STANDARD", 4200.0, "4'-6'"),
    ("425-4-13", "CATCH_BASIN", "STANDARD", 5000.0, "6'-8'"),
)
# The code by type where the subtype is standard or unknown.
DEFAULT_STRUCTURES = {
    "INLET": ("425-1-541", 4200.0),
    "MANHOLE": ("425-2-41", 5500.0),
    "JUNCTION_BOX": ("425-3-11", 3800.0),
    "CATCH_BASIN": ("425-4-11", 3500.0),
}
# The code that stands for a subtype.
SUBTYPE_CODES = {
    "DITCH BOTTOM TYPE D MODIFIED": ("425-1-549", 5800.00),
    "DITCH BOTTOM TYPE D": ("425-1-531", 4800.00),
    "DITCH BOTTOM TYPE C": ("425-1-541", 4200.00),
    "DITCH BOTTOM TYPE E": ("425-1-551", 4000.00),
    "DITCH BOTTOM TYPE H": ("425-1-561", 5500.00),
    "DITCH BOTTOM TYPE J": ("425-1-571", 5200.00),
    "CURB TYPE A": ("425-1-101", 3200.00),
    "CURB TYPE B": ("425-1-201", 3500.00),
    "CURB TYPE P": ("425-1-601", 6500.00),
    "CURB TYPE P-5": ("425-1-621", 7200.00),
    "CURB TYPE P-6": ("425-1-631", 8800.00),
    "CURB TYPE 9": ("425-1-901", 5500.00),
    "SLOTTED TYPE S": ("425-1-701", 4800.00),
    "VALLEY GUTTER TYPE V": ("425-1-751", 4200.00),
    "TYPE 7": ("425-2-41", 5500.00),
    "TYPE J": ("425-2-31", 4500.00),
    "TYPE P": ("425-2-71", 5500.00),
    "TYPE P-7": ("425-2-81", 6200.00),
}
# Structure wordings in order (pattern, type, subtype).
STRUCTURE_WORDINGS: tuple[tuple[str, str, str | None], ...] = (
    (r"\bTYPE\s*D\s*(?:INLET\s*)?[\(\[]?\s*(?:MODIFIED|MOD)", "INLET", "DITCH BOTTOM TYPE D MODIFIED"),
    (r"\bINLET.*TYPE\s*D.*(?:MODIFIED|MOD)", "INLET", "DITCH BOTTOM TYPE D MODIFIED"),
    (r"(?:MODIFIED|MOD).*TYPE\s*D\s*INLET", "INLET", "DITCH BOTTOM TYPE D MODIFIED"),
    (r"\bD\s*(?:MODIFIED|MOD)\s*INLET\b", "INLET", "DITCH BOTTOM TYPE D MODIFIED"),
    (r"\bMODIFIED\s*(?:TYPE\s*)?D\b", "INLET", "DITCH BOTTOM TYPE D MODIFIED"),
    (r"\bTYPE\s*D\s*INLET\b", "INLET", "DITCH BOTTOM TYPE D"),
    (r"\bTYPE\s*D\b.*\bINLET\b(?!\s*[\(\[]?\s*(?:MODIFIED|MOD))", "INLET", "DITCH BOTTOM TYPE D"),
    (r"\bINLET.*\bTYPE\s*D\b(?!\s*[\(\[]?\s*(?:MODIFIED|MOD))", "INLET", "DITCH BOTTOM TYPE D"),
    (r"\bD\s*INLET\b", "INLET", "DITCH BOTTOM TYPE D"),
    (r"\bTYPE\s*C\s*INLET\b", "INLET", "DITCH BOTTOM TYPE C"),
    (r"\bTYPE\s*C\b.*\bINLET\b", "INLET", "DITCH BOTTOM TYPE C"),
    (r"\bINLET.*\bTYPE\s*C\b", "INLET", "DITCH BOTTOM TYPE C"),
    (r"\bC\s*INLET\b", "INLET", "DITCH BOTTOM TYPE C"),
    (r"\bTYPE\s*E\s*INLET\b", "INLET", "DITCH BOTTOM TYPE E"),
    (r"\bTYPE\s*E\b.*\bINLET\b", "INLET", "DITCH BOTTOM TYPE E"),
    (r"\bINLET.*\bTYPE\s*E\b", "INLET", "DITCH BOTTOM TYPE E"),
    (r"\bDITCH\s*BOTTOM\s*INLET\s*TYPE\s*E\b", "INLET", "DITCH BOTTOM TYPE E"),
    (r"\bE\s*INLET\b", "INLET", "DITCH BOTTOM TYPE E"),
    (r"\bTYPE\s*H\s*INLET\b", "INLET", "DITCH BOTTOM TYPE H"),
    (r"\bTYPE\s*H\b.*\bINLET\b", "INLET", "DITCH BOTTOM TYPE H"),
    (r"\bH\s*INLET\b", "INLET", "DITCH BOTTOM TYPE H"),
    (r"\bTYPE\s*J\s*INLET\b", "INLET", "DITCH BOTTOM TYPE J"),
    (r"\bTYPE\s*J\b.*\bINLET\b", "INLET", "DITCH BOTTOM TYPE J"),
    (r"\bJ\s*(?:BOTTOM\s*)?INLET\b", "INLET", "DITCH BOTTOM TYPE J"),
    (r"\bTYPE\s*P[-\s]?[5-7]?\s*INLET\b", "INLET", "CURB TYPE P"),
    (r"\bP[-\s]?5\s*INLET\b", "INLET", "CURB TYPE P-5"),
    (r"\bP[-\s]?6\s*INLET\b", "INLET", "CURB TYPE P-6"),
    (r"\bCURB\s*INLET\s*TYPE\s*P\b", "INLET", "CURB TYPE P"),
    (r"\bTYPE\s*9\s*INLET\b", "INLET", "CURB TYPE 9"),
    (r"\bTYPE\s*9\b.*\bINLET\b", "INLET", "CURB TYPE 9"),
    (r"\bCURB\s*INLET\s*TYPE\s*9\b", "INLET", "CURB TYPE 9"),
    (r"\bTYPE\s*A\s*INLET\b", "INLET", "CURB TYPE A"),
    (r"\bTYPE\s*B\s*INLET\b", "INLET", "CURB TYPE B"),
    (r"\bTYPE\s*S\s*INLET\b", "INLET", "SLOTTED TYPE S"),
    (r"\bSLOTTED\s*(?:DRAIN\s*)?INLET\b", "INLET", "SLOTTED TYPE S"),
    (r"\bTYPE\s*V\s*INLET\b", "INLET", "VALLEY GUTTER TYPE V"),
    (r"\bVALLEY\s*(?:GUTTER\s*)?INLET\b", "INLET", "VALLEY GUTTER TYPE V"),
    (r"\bGUTTER\s*INLET\b", "INLET", "VALLEY GUTTER TYPE V"),
    (r"\bDITCH\s*BOTTOM\s*INLET\b(?!\s*TYPE)", "INLET", "DITCH BOTTOM TYPE C"),
    (r"\bCURB\s*INLET\b", "INLET", "CURB TYPE B"),
    (r"\bINLET\s*#?\d*\b", "INLET", None),
    (r"\bTYPE\s*7\s*MANHOLE\b", "MANHOLE", "TYPE 7"),
    (r"\bTYPE\s*7\b.*\bMANHOLE\b", "MANHOLE", "TYPE 7"),
    (r"\bMANHOLE.*\bTYPE\s*7\b", "MANHOLE", "TYPE 7"),
    (r"\bMH\s*TYPE\s*7\b", "MANHOLE", "TYPE 7"),
    (r"\bTYPE\s*J\s*MANHOLE\b", "MANHOLE", "TYPE J"),
    (r"\bTYPE\s*J\b.*\bMANHOLE\b", "MANHOLE", "TYPE J"),
    (r"\bMANHOLE.*\bTYPE\s*J\b", "MANHOLE", "TYPE J"),
    (r"\bJ\s*BOTTOM\s*MANHOLE\b", "MANHOLE", "TYPE J"),
    (r"\bTYPE\s*P[-\s]?7?\s*MANHOLE\b", "MANHOLE", "TYPE P"),
    (r"\bP[-\s]?7\s*MANHOLE\b", "MANHOLE", "TYPE P-7"),
    (r"\bMANHOLE\s*#?\d*\b", "MANHOLE", None),
    (r"\bMH\s*#?\d*\b", "MANHOLE", None),
    (r"\bJUNCTION\s*BOX\b", "JUNCTION_BOX", "STANDARD"),
    (r"\bJCT\s*BOX\b", "JUNCTION_BOX", "STANDARD"),
    (r"\bJB\s*#?\d*\b", "JUNCTION_BOX", "STANDARD"),
    (r"\bCATCH\s*BASIN\b", "CATCH_BASIN", "STANDARD"),
    (r"\bCB\s*#?\d*\b", "CATCH_BASIN", "STANDARD"),
)

# Pattern, then the groups of quantity, unit, size, material, class.
QUANTITY_FIRST = (
    (r'(\d+(?:\.\d+)?)\s*(LF|EA|SF|SY|CY)\s+(\d+)\s*["\u201d\u2033]?\s*(RCP|PVC|HDPE|CMP|DIP|SRCP)(?:\s*(?:CLASS\s*)?([IVX]+))?', 1, 2, 3, 4, 5),
    (r'(\d+(?:\.\d+)?)\s*(LF|EA)\s+(\d+)\s*["\u201d\u2033]?\s*(PVC|HDPE)\s*(?:SDR\s*)?(\d+)?', 1, 2, 3, 4, 5),
    (r'(\d+)\s*["\u201d\u2033]\s*(RCP|PVC|HDPE|CMP|DIP|SRCP)\s*[-\u2013\u2014]\s*(\d+(?:\.\d+)?)\s*(LF|EA|SF|SY)', 3, 4, 1, 2, None),
    (r'(\d+)\s*["\u201d\u2033]\s*(RCP|PVC|HDPE|CMP|DIP|SRCP)\s*\(\s*(\d+(?:\.\d+)?)\s*(LF|EA|SF|SY)\s*\)', 3, 4, 1, 2, None),
    (r'(\d+(?:\.\d+)?)\s*(LF|EA|SF|SY|CY)\s+(?:of\s+)?(\d+)\s*["\u201d\u2033]\s*(RCP|PVC|HDPE|CMP|DIP|SRCP)', 1, 2, 3, 4, None),
    (r'(RCP|PVC|HDPE|CMP|DIP|SRCP)\s*(\d+)\s*["\u201d\u2033]?\s*[@=]\s*(\d+(?:\.\d+)?)\s*(LF|EA|SF|SY)', 3, 4, 2, 1, None),
    (r'(\d+(?:\.\d+)?)\s*(LF|EA)\s+(RCP|PVC|HDPE|CMP|DIP|SRCP)\s*(\d+)\s*["\u201d\u2033]?', 1, 2, 4, 3, None),
    (r'(\d+)\s*["\u201d\u2033]\s*(RCP|PVC|HDPE|CMP|DIP|SRCP)\s+(LF|EA|SF|SY)\s+(\d+(?:\.\d+)?)', 4, 3, 1, 2, None),
)
# Pattern, then the groups of material and size.
CALLOUTS = (
    (r"\b(RCP|PVC|HDPE|CMP|DIP|SRCP)\s*-?\s*(\d+)\b", 1, 2),
    (r'\b(\d+)["\s]*(RCP|PVC|HDPE|CMP|DIP|SRCP)\b', 2, 1),
)
# Pattern, type.
GENERIC_LABELS = (
    (r"\b(MANHOLE|MH)\b(?!\s*[#-]?\s*\d)", "MANHOLE"),
    (r"\b(INLET)\b(?!\s*[#-]?\s*\d)", "INLET"),
    (r"\b(CATCH\s*BASIN|CB)\b(?!\s*[#-]?\s*\d)", "CATCH BASIN"),
    (r"\b(JUNCTION\s*BOX|JB)\b(?!\s*[#-]?\s*\d)", "JUNCTION BOX"),
)
# Pattern, then the groups of quantity, unit, rise, span, class.
ELLIPTICAL = (
    (r'(\d+(?:\.\d+)?)\s*(LF|EA)\s+(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*(?:RCP|ERCP)?\s*(?:HE|ELLIP(?:TICAL)?)?(?:\s*(?:CL(?:ASS)?\s*)?([IVX]+))?', 1, 2, 3, 4, 5),
    (r'(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*(?:RCP\s*HE|ERCP|ELLIP(?:TICAL)?\s*RCP)\s*[-\u2013\u2014]\s*(\d+(?:\.\d+)?)\s*(LF|EA)', 3, 4, 1, 2, None),
    (r'(?:ERCP|RCP\s*HE|ELLIP(?:TICAL)?\s*RCP)\s*(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?', None, None, 1, 2, None),
    (r'(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*(?:RCP\s*HE|ERCP|ELLIP(?:TICAL)?\s*RCP)(?:\s*(?:CL(?:ASS)?\s*)?([IVX]+))?', None, None, 1, 2, 3),
)
# Pattern, then the groups of rise and span; two for flared ends, three for mitered ends.
ELLIPTICAL_ENDS = (
    (r'(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*(?:FLARED\s*END(?:\s*SECTION)?|FE|FES)', 1, 2),
    (r'(?:FLARED\s*END(?:\s*SECTION)?|FE|FES)\s*(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?', 1, 2),
    (r'(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*MES(?:\s*4:1)?', 1, 2),
    (r'MES\s*(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?(?:\s*4:1)?', 1, 2),
    (r'MITERED\s*END(?:\s*SECTION)?\s*(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?', 1, 2),
)
# Pattern, type, then the groups of size, configuration (span for elliptical ones), option.
STRUCTURE_ITEMS = (
    (r'(\d+)\s*["\u201d]?\s*STRAIGHT\s*(?:CONCRETE\s*)?END\s*WALL[S]?\s*(SINGLE|DOUBLE|TRIPLE|QUAD)?', "STRAIGHT_ENDWALL", 1, 2, None),
    (r'STRAIGHT\s*(?:CONCRETE\s*)?END\s*WALL[S]?\s*(\d+)\s*["\u201d]?\s*(SINGLE|DOUBLE|TRIPLE|QUAD)?', "STRAIGHT_ENDWALL", 1, 2, None),
    (r'(\d+)\s*["\u201d]?\s*(?:WINGED?|WING)\s*(?:END\s*)?WALL[S]?\s*(45\s*DEG(?:REE)?|U[-\s]?TYPE)?', "WINGED_ENDWALL", 1, 2, None),
    (r'(?:WINGED?|WING)\s*(?:END\s*)?WALL[S]?\s*(\d+)\s*["\u201d]?\s*(45\s*DEG(?:REE)?|U[-\s]?TYPE)?', "WINGED_ENDWALL", 1, 2, None),
    (r'(\d+)\s*["\u201d]?\s*U[-\s]?TYPE\s*(?:END\s*WALL)?\s*([2-6]:1)?(?:\s*(?:WITH\s*)?(GRATE\s*AND\s*BAFFLES|GRATE|BAFFLES))?', "U_TYPE_ENDWALL", 1, 2, 3),
    (r'U[-\s]?TYPE\s*(?:END\s*WALL)?\s*(\d+)\s*["\u201d]?\s*([2-6]:1)?(?:\s*(?:WITH\s*)?(GRATE\s*AND\s*BAFFLES|GRATE|BAFFLES))?', "U_TYPE_ENDWALL", 1, 2, 3),
    (r'(\d+)\s*["\u201d]?\s*(?:PIPE\s*)?CRADLE', "PIPE_CRADLE", 1, None, None),
    (r'(?:PIPE\s*)?CRADLE\s*(\d+)\s*["\u201d]?', "PIPE_CRADLE", 1, None, None),
    (r'(\d+)\s*["\u201d]?\s*MES(?:\s*4:1)?', "MES", 1, None, None),
    (r'MES(?:\s*4:1)?\s*(\d+)\s*["\u201d]?', "MES", 1, None, None),
    (r'MITERED\s*END(?:\s*SECTION)?\s*(\d+)\s*["\u201d]?', "MES", 1, None, None),
    (r'(\d+)\s*["\u201d]?\s*MITERED\s*END(?:\s*SECTION)?', "MES", 1, None, None),
    (r'(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*MES', "MES_ELLIPTICAL", 1, 2, None),
    (r'MES\s*(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?', "MES_ELLIPTICAL", 1, 2, None),
    (r'(\d+)\s*["\u201d]?\s*FLARED\s*END(?:\s*SECTION)?', "FLARED_END", 1, None, None),
    (r'FLARED\s*END(?:\s*SECTION)?\s*(\d+)\s*["\u201d]?', "FLARED_END", 1, None, None),
)
# Pattern, then the groups of size, run, frame, or of rise, span, run, frame.
GALVANIZED = (
    (r'(\d+)\s*["\u201d]?\s*(?:GALV(?:ANIZED)?(?:\s*STEEL)?)\s*(?:4:1\s*)?MES(?:\s*(SINGLE|DOUBLE|TRIPLE)\s*RUN)?(?:\s*(WITH|NO)\s*FRAME)?', 1, 2, 3),
    (r'(?:GALV(?:ANIZED)?(?:\s*STEEL)?)\s*(?:4:1\s*)?MES\s*(\d+)\s*["\u201d]?(?:\s*(SINGLE|DOUBLE|TRIPLE)\s*RUN)?(?:\s*(WITH|NO)\s*FRAME)?', 1, 2, 3),
    (r'(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?\s*(?:GALV(?:ANIZED)?(?:\s*STEEL)?)\s*(?:4:1\s*)?MES(?:\s*(SINGLE|DOUBLE|TRIPLE)\s*RUN)?(?:\s*(WITH|NO)\s*FRAME)?', 1, 2, 3, 4),
    (r'(?:GALV(?:ANIZED)?(?:\s*STEEL)?)\s*(?:4:1\s*)?MES\s*(\d+)\s*["\u201d]?\s*[xX×]\s*(\d+)\s*["\u201d]?(?:\s*(SINGLE|DOUBLE|TRIPLE)\s*RUN)?(?:\s*(WITH|NO)\s*FRAME)?', 1, 2, 3, 4),
)
