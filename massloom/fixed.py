"""Fixed values.

Every number, word and pattern below must equal the published contract for
results to agree; they are stated plainly and kept together.
"""

# Ion arithmetic (Da).
PROTON = 1.007276466621
ELECTRON = 0.000548579909
WATER = 18.01056468403
WATER_LOSS = 18.010564684
FORMIC_ACID = 46.0054793036
HYDROGEN_ATOM = 1.00782503223

# adduct text -> (multiplicity, signed charge, mass shift)
ADDUCTS = {
    "[M+H]+": (1, 1, PROTON),
    "[M-H]-": (1, -1, -PROTON),
    "[M+Na]+": (1, 1, 22.989220702),
    "[M+K]+": (1, 1, 38.963157906),
    "[M+NH4]+": (1, 1, 18.033825553),
    "[M+Cl]-": (1, -1, 34.969401262),
    "[M+2H]2+": (1, 2, 2 * PROTON),
    "[M-2H]2-": (1, -2, -2 * PROTON),
    "[2M+H]+": (2, 1, PROTON),
    "[2M-H]-": (2, -1, -PROTON),
    "[M-H2O+H]+": (1, 1, PROTON - WATER),
    "[M-2H2O+H]+": (1, 1, PROTON - 2 * WATER),
    "[M-H2O-H]-": (1, -1, -PROTON - WATER),
    "[M+CH2O2-H]-": (1, -1, FORMIC_ACID - PROTON),
    "[M]+": (1, 1, -ELECTRON),
    "[M]-": (1, -1, ELECTRON),
}

# Mass of the most abundant isotope (Da), or of the longest-lived one, by atomic number.
ELEMENT_MASS = {
    "H": 1.00782503223, "He": 4.00260325413, "Li": 7.0160034366, "Be": 9.012183065, "B": 11.00930536,
    "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Ne": 19.9924401762,
    "Na": 22.989769282, "Mg": 23.985041697, "Al": 26.98153853, "Si": 27.97692653465, "P": 30.97376199842,
    "S": 31.9720711744, "Cl": 34.968852682, "Ar": 39.9623831237, "K": 38.9637064864, "Ca": 39.962590863,
    "Sc": 44.95590828, "Ti": 47.94794198, "V": 50.94395704, "Cr": 51.94050623, "Mn": 54.93804391,
    "Fe": 55.93493633, "Co": 58.93319429, "Ni": 57.93534241, "Cu": 62.92959772, "Zn": 63.92914201,
    "Ga": 68.9255735, "Ge": 73.921177761, "As": 74.92159457, "Se": 79.9165218, "Br": 78.9183376,
    "Kr": 83.9114977282, "Rb": 84.9117897379, "Sr": 87.9056125, "Y": 88.9058403, "Zr": 89.9046977,
    "Nb": 92.906373, "Mo": 97.90540482, "Tc": 97.9072124, "Ru": 101.9043441, "Rh": 102.905498,
    "Pd": 105.9034804, "Ag": 106.9050916, "Cd": 113.90336509, "In": 114.903878776, "Sn": 119.90220163,
    "Sb": 120.903812, "Te": 129.906222748, "I": 126.9044719, "Xe": 131.9041550856, "Cs": 132.905451961,
    "Ba": 137.905247, "La": 138.9063563, "Ce": 139.9054431, "Pr": 140.9076576, "Nd": 141.907729,
    "Pm": 144.9127559, "Sm": 151.9197397, "Eu": 152.921238, "Gd": 157.9241123, "Tb": 158.9253547,
    "Dy": 163.9291819, "Ho": 164.9303288, "Er": 165.9302995, "Tm": 168.9342179, "Yb": 173.9388664,
    "Lu": 174.9407752, "Hf": 179.946557, "Ta": 180.9479958, "W": 183.95093092, "Re": 186.9557501,
    "Os": 191.961477, "Ir": 192.9629216, "Pt": 194.9647917, "Au": 196.96656879, "Hg": 201.9706434,
    "Tl": 204.9744278, "Pb": 207.9766525, "Bi": 208.9803991, "Po": 208.9824308, "At": 209.9871479,
    "Rn": 222.0175782, "Fr": 223.019736, "Ra": 226.0254103, "Ac": 227.0277523, "Th": 232.0380558,
    "Pa": 231.0358842, "U": 238.0507884,
}
FORMULA_ELEMENTS = ("C", "H", "N", "O", "P", "S", "F", "Cl", "Br", "I")
FORMULA_CONTROL_SHIFTS = (-0.2345678, 0.1234567, 0.3456789)

# Tolerances: (ppm, absolute Da).
CANDIDATE_TOLERANCE = (20.0, 0.005)
EXPANDED_TOLERANCE = (50.0, 0.02)
ADMISSION_TOLERANCE = (50.0, 0.003)
FRAGMENT_TOLERANCE = (20.0, 0.01)
FORMULA_TOLERANCE = (5.0, 0.001)
NEAREST_FALLBACK = 64
INTERVAL_PADDING = 0.001
INTERVAL_SLACK = 1e-10

# Peaks must lie strictly below precursor - margin.
REFERENCE_MARGIN = 0.01
FORWARD_MARGIN = 0.5

# Histogram features.
BINS = 2048

# Hash salts (text hashed is salt + key unless noted).
SALT_HOLDOUT = "official-split-v1:"
SALT_SAMPLE = "sample-v1:"
SALT_FRESH = "v3-implementation-r05:"
SALT_ROLES = "architecture-r06:"
SALT_TARGET = "R07-target-split-20260917:"
SALT_ACQUISITION = "R03-acquisition:"

# Forward evidence.
FORWARD_ADDUCTS = ("[M+H]+", "[M-H]-")
FORWARD_ENERGIES = (10.0, 20.0, 40.0, 60.0)

# Ranking.
TOP_K = 25
GATE_THRESHOLD = 0.9
GATE_MARGIN = 0.1
HEAD_WEIGHTS = (0.5, 0.25, 0.25)
LOGIT_CLIP = 16.11809555

# Redaction.
SECRET_PATTERN = r"KGAT_[A-Za-z0-9_\-]+"
REDACTED = "[REDACTED]"

# Logical field -> accepted column names, in order of preference.
ALIASES = {
    "compound_id": ("compound_id", "molecule_id", "compound", "molecule", "sample_id", "id"),
    "precursor_mz": ("precursor_mz", "precursor_mass", "pepmass", "parent_mz"),
    "adduct": ("adduct", "precursor_type", "ion_type"),
    "mz": ("ms2_mzs", "mz", "mzs", "m/z", "mz_array"),
    "intensity": ("ms2_normalized_intensities", "intensity", "intensities", "intensity_array"),
    "peaks": ("peaks", "spectrum"),
    "smiles": ("normalized_smiles", "smiles", "canonical_smiles"),
    "collision_energy": ("collision_energy_ev", "collision_energy", "ce"),
}
QUERY_COLUMNS = (
    "molecule_id", "ms2_mzs", "ms2_normalized_intensities",
    "precursor_mz", "adduct", "collision_energy_ev",
)
SNAPSHOT_COLUMNS = ("identifier", "canonical_smiles", "exact_molecular_weight")
DATA_SUFFIXES = ("jsonl", "ndjson", "mgf", "csv", "tsv", "parquet")
