"""Fixed values of the domain: patterns, tables and names that results depend on. Stated plainly, in order."""

# Lipid classes by name. The order matters, specific classes stand before general ones.
CLASSES = [
    ("DLCL", "glycerophospholipid", [r"\bdilysocardiolipin\b", r"\bDLCL\b"]),
    ("MLCL", "glycerophospholipid", [r"\bmonolysocardiolipin\b", r"\bMLCL\b"]),
    ("CL", "glycerophospholipid", [r"\bcardiolipin\b", r"\bCL\s*\("]),
    ("LBMP", "glycerophospholipid", [r"\blysobis\(monoacylglycero\)phosphate\b", r"\blyso[- ]?BMP\b", r"\bLBMP\b"]),
    ("BMP", "glycerophospholipid", [r"\bbis\(monoacylglycero\)phosphate\b", r"\blysobisphosphatidic acid\b", r"\bBMP\b"]),
    ("PIP3", "glycerophospholipid", [r"phosphatidylinositol[^;]*trisphosphate", r"\bPIP3\b", r"\bPI\(.*\)P3\b"]),
    ("PIP2", "glycerophospholipid", [r"phosphatidylinositol[^;]*bisphosphate", r"\bPIP2\b", r"\bPI\(.*\)P2\b"]),
    ("PIP", "glycerophospholipid", [r"phosphatidylinositol[^;]*monophosphate", r"\bPIP\b", r"\bPI\(.*\)P\b"]),
    ("CDP-DAG", "glycerophospholipid", [r"\bCDP[- ]?(?:DAG|diacylglycerol)\b", r"cytidine diphosphate diacylglycerol"]),
    ("PGP", "glycerophospholipid", [r"phosphatidylglycerol phosphate", r"\bPGP\b"]),
    ("LNAPE", "glycerophospholipid", [r"\blyso[- ]?N[- ]?acyl.*phosphatidylethanolamine\b", r"\bLNAPE\b"]),
    ("NAPE", "glycerophospholipid", [r"\bN[- ]?acyl.*phosphatidylethanolamine\b", r"\bNAPE\b"]),
    ("DMPE", "glycerophospholipid", [r"dimethyl.*phosphatidylethanolamine", r"\bDMPE\b"]),
    ("MMPE", "glycerophospholipid", [r"monomethyl.*phosphatidylethanolamine", r"\bMMPE\b"]),
    ("LPC", "glycerophospholipid", [r"\blysophosphatidylcholine\b", r"\blyso[- ]?PC\b", r"\bLPC\b"]),
    ("LPE", "glycerophospholipid", [r"\blysophosphatidylethanolamine\b", r"\blyso[- ]?PE\b", r"\bLPE\b"]),
    ("LPG", "glycerophospholipid", [r"\blysophosphatidylglycerol\b", r"\blyso[- ]?PG\b", r"\bLPG\b"]),
    ("LPI", "glycerophospholipid", [r"\blysophosphatidylinositol\b", r"\blyso[- ]?PI\b", r"\bLPI\b"]),
    ("LPS", "glycerophospholipid", [r"\blysophosphatidylserine\b", r"\blyso[- ]?PS\b", r"\bLPS\b"]),
    ("LPA", "glycerophospholipid", [r"\blysophosphatidic acid\b", r"\blyso[- ]?PA\b", r"\bLPA\b"]),
    ("PC", "glycerophospholipid", [r"\bphosphatidylcholine\b", r"\bglycerophosphocholine\b", r"\bPC\s*\("]),
    ("PE", "glycerophospholipid", [r"\bphosphatidylethanolamine\b", r"\bglycerophosphoethanolamine\b", r"\bPE\s*\("]),
    ("PG", "glycerophospholipid", [r"\bphosphatidylglycerol\b", r"\bphosphatidylglyceride\b", r"\bPG\s*\("]),
    ("PI", "glycerophospholipid", [r"\bphosphatidylinositol\b", r"\bglycerophosphoinositol\b", r"\bPI\s*\("]),
    ("PS", "glycerophospholipid", [r"\bphosphatidylserine\b", r"\bglycerophosphoserine\b", r"\bPS\s*\("]),
    ("PA", "glycerophospholipid", [r"\bphosphatidic acid\b", r"\bglycerophosphate\b", r"\bPA\s*\("]),
    ("PEt", "glycerophospholipid", [r"\bphosphatidylethanol\b", r"\bPEt\b"]),
    ("PMe", "glycerophospholipid", [r"\bphosphatidylmethanol\b", r"\bPMe\b"]),
    ("PPr", "glycerophospholipid", [r"\bphosphatidylpropanol\b", r"\bPPr\b"]),
    ("PBut", "glycerophospholipid", [r"\bphosphatidylbutanol\b", r"\bPBut\b"]),
    ("PT", "glycerophospholipid", [r"\bphosphatidylthreonine\b", r"\bPT\s*\("]),
    ("PHS", "glycerophospholipid", [r"\bphosphatidylhomoserine\b", r"\bPHS\b"]),
    ("PGlc", "glycerophospholipid", [r"\bphosphatidylglucose\b", r"\bPGlc\b"]),
    ("PMan", "glycerophospholipid", [r"\bphosphatidylmannitol\b", r"\bPMan\b"]),
    ("PIM", "complex_bacterial_phospholipid", [r"phosphatidylinositol mannoside", r"\bPIM[1-6]?\b"]),
    ("LysoSM", "sphingophospholipid", [r"\blysosphingomyelin\b", r"\blyso[- ]?SM\b"]),
    ("SM", "sphingophospholipid", [r"\bsphingomyelin\b", r"\bSM\s*\("]),
    ("CerP", "sphingophospholipid", [r"\bceramide[- ]?1[- ]?phosphate\b", r"\bceramide phosphate\b", r"\bCerP\b"]),
    ("dhS1P", "sphingophospholipid", [r"\bdihydrosphingosine[- ]?1[- ]?phosphate\b", r"\bsphinganine[- ]?1[- ]?phosphate\b", r"\bdhS1P\b"]),
    ("S1P", "sphingophospholipid", [r"\bsphingosine[- ]?1[- ]?phosphate\b", r"\bS1P\b"]),
    ("CerPE", "sphingophospholipid", [r"\bceramide phosphoethanolamine\b", r"\bCPE\b", r"\bCerPE\b"]),
    ("MIP2C", "sphingophospholipid", [r"mannosyldiinositolphosphorylceramide", r"\bM\(IP\)2C\b", r"\bMIP2C\b"]),
    ("MIPC", "sphingophospholipid", [r"mannosylinositolphosphorylceramide", r"\bMIPC\b"]),
    ("IPC", "sphingophospholipid", [r"\binositolphosphorylceramide\b", r"\bIPC\b"]),
    ("archaetidyl-phospholipid", "archaeal_phospholipid", [r"\barchaetidyl", r"\bcaldarchaetidyl", r"\barchaeol phosphate\b"]),
    ("phosphonolipid", "phosphonolipid", [r"\bphosphonolipid\b", r"\bphosphono.*lipid\b"]),
]

# Linkage modifications; all that hit are reported.
MODIFICATIONS = [
    ("plasmalogen", [r"\bplasmalogen\b", r"\balkenyl\b", r"\bP-\d"]),
    ("ether", [r"\balkyl ether\b", r"\bether lipid\b", r"\bO-\d"]),
    ("oxidized", [r"\boxidized\b", r"\boxPC\b", r"\bhydroperoxy\b", r"\bhydroxy.*phosphatidyl"]),
]

# What a record is called that no class name fits.
UNRESOLVED, CANDIDATE_FAMILY = "P-lipid-unresolved", "phosphorus_lipid_candidate"

# Hints of a chain, and names of compounds that hold phosphorus but aren't lipids.
CHAIN_HINTS = r"\b\d{1,2}:\d{1,2}\b|phosphatid|glycerophosph|sphingo|ceramide|cardiolipin|plasmalogen|archaetid|inositolphosphorylceramide|phosphonolipid"
EXCLUDED_NAMES = r"\b(?:ATP|ADP|AMP|GTP|GDP|GMP|CTP|CDP(?![- ]?(?:DAG|diacylglycerol))|UTP|UDP|UMP|coenzyme A|acetyl[- ]?CoA|nucleotide|oligonucleotide|DNA|RNA)\b"
SUSPICIOUS_NAMES = r"\b(?:CoA|coenzyme|ATP|ADP|AMP|GTP|GDP|GMP|nucleotide|oligonucleotide|DNA|RNA|diazinon|malaoxon)\b"

# Canonical case of adduct parts, the longest first.
ADDUCT_PARTS = ["CH3COO", "HCOO", "NH4", "Na", "Cl", "K", "H"]
ION_MODES = ["POSITIVE", "NEGATIVE", "POS", "NEG", "ION_MODE POSITIVE", "ION_MODE NEGATIVE"]

# Terms of a class in a reference entry's text.
CLASS_TERMS = {
    "PC": ["glycerophosphocholine", "phosphocholine", " pc ", "lpc"],
    "LPC": ["monoacylglycerophosphocholine", "lysophosphatidylcholine", " lpc ", " lyso-pc"],
    "PE": ["glycerophosphoethanolamine", "phosphoethanolamine", " pe ", "lpe"],
    "LPE": ["monoacylglycerophosphoethanolamine", "lysophosphatidylethanolamine", " lpe "],
    "PI": ["glycerophosphoinositol", "phosphatidylinositol", " pi "],
    "PG": ["glycerophosphoglycerol", "phosphatidylglycerol", " pg "],
    "LPG": ["lysophosphatidylglycerol", " lpg "],
    "PS": ["glycerophosphoserine", "phosphatidylserine", " ps "],
    "PA": ["glycerophosphate", "phosphatidic acid", " pa "],
    "LPA": ["lysophosphatidic acid", " lpa "],
    "SM": ["sphingomyelin", "ceramide phosphocholine", " sm("],
    "LysoSM": ["lysosphingomyelin", "lyso-sm"],
    "S1P": ["sphingosine-1-phosphate", "sphingosine 1-phosphate", " s1p"],
}

# Versions that enter the hashes.
HASH_VERSION, STANDARDIZATION_VERSION = "v2.0", "structure-connectivity-v1"

# Label vocabularies of the model.
HEADGROUPS = ["PA", "PC", "PE", "PG", "PI", "PS"]
POLARITIES = ["negative", "positive"]
LINKAGES = ["ester", "ether", "vinyl_ether"]
MIN_CARBON, MAX_CARBON, MAX_DOUBLE_BONDS, MAX_CHAINS = 2, 40, 12, 2

# Class of a headgroup with one or two chains.
CLASS_OF = {
    ("phosphocholine", 2): "PC", ("phosphocholine", 1): "LPC", ("phosphoethanolamine", 2): "PE", ("phosphoethanolamine", 1): "LPE",
    ("phosphoglycerol", 2): "PG", ("phosphoglycerol", 1): "LPG", ("phosphoinositol", 2): "PI", ("phosphoinositol", 1): "LPI",
    ("phosphoserine", 2): "PS", ("phosphoserine", 1): "LPS", ("phosphate", 2): "PA", ("phosphate", 1): "LPA",
}

# Classes the structure parser supports, in report order, and classes it must not derive for a control class.
SUPPORTED_CLASSES = ["PA", "PC", "PE", "PG", "PI", "PS", "LPA", "LPC", "LPE", "LPG", "LPI", "LPS"]
CONTROL_CLASSES = {"SM": ["PC", "LPC"], "S1P": ["PA", "LPA"], "NAPE": ["PE", "LPE"], "BMP": ["PG", "LPG"], "CL": ["PG", "LPG", "PA", "LPA"]}
