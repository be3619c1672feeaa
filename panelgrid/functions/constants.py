"""Fixed values. They must stay as they are for results to be right."""

# Land-cover code, merged class, class code used by the site records.
LAND_COVER = [
    (1, "ENF", "ENF"),
    (2, "EBF", "EBF"),
    (3, "DNF", "DNF"),
    (4, "DBF", "DBF"),
    (5, "MF", "MF"),
    (6, "SH", "CSH"),
    (7, "SH", "OSH"),
    (8, "SAV", "WSA"),
    (9, "SAV", "SAV"),
    (10, "GRA", "GRA"),
    (11, "WET", "WET"),
    (12, "CRO", "CRO"),
    (13, "URB", "URB"),
    (14, "CVM", "CVM"),
    (15, "SNO", "SNO"),
    (16, "BSV", "BSV"),
    (17, "WAT", "WAT"),
]

# Lookups derived from the table above; pixel code 0 means "no class".
CODE_TO_CLASS = {code: merged for code, merged, _ in LAND_COVER}
SITE_CODE_TO_CLASS = {site: merged for _, merged, site in LAND_COVER}
PIXEL_CODE_TO_CLASS = {0: "NAN", **CODE_TO_CLASS}

# Classes that get no grid prediction.
UNSCORED_CLASSES = ["SNO", "BSV", "WAT", "NAN"]

# Classes reported by the uncertainty summary.
REPORTED_CLASSES = ["ENF", "EBF", "DBF", "MF", "SH", "SAV", "GRA", "WET", "CRO"]

# One-hot columns of the grid scorer, in training order.
SCORED_CLASS_COLUMNS = ["BSV", "CRO", "CVM", "DBF", "EBF", "ENF", "GRA", "MF", "SAV", "SH",
                        "URB", "WAT", "WET"]

# Main climate codes.

# World area per class (km2).
CLASS_AREA = {"ENF": 2411991, "EBF": 12052970, "DBF": 2898066, "MF": 4786627, "SH": 13841035,
              "SAV": 27642838, "GRA": 30682224, "WET": 1475918, "CRO": 11685607}

# Class corrections of single sites.
SITE_CLASS_PATCHES = {"DE-Hte": "WET", "RU-Fy2": "ENF"}

# Names of explanatory variable sets and their columns.
VARIABLE_SETS = {
    "rs_min": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "BESS-PAR"],
    "rs_min_vi": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "BESS-PAR", "NDVI", "EVI", "GCI",
                  "NDWI", "NIRv", "kNDVI"],
    "rs_min_yr": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "BESS-PAR", "year"],
    "rs_min_sif": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "BESS-PAR", "CSIF-SIFdaily",
                   "CSIF-SIFinst"],
    "rs": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "LST_Day", "LST_Night", "Lai", "Fpar",
           "CSIF-SIFdaily", "CSIF-SIFinst", "BESS-PAR", "BESS-RSDN", "BESS-PARdiff", "ESACCI-sm",
           "ET", "MODIS_LC"],
    "rs_yr": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "LST_Day", "LST_Night", "Lai", "Fpar",
              "CSIF-SIFdaily", "CSIF-SIFinst", "BESS-PAR", "BESS-RSDN", "BESS-PARdiff",
              "ESACCI-sm", "ET", "year", "MODIS_LC"],
    "rs_vi": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "NDVI", "EVI", "GCI", "NDWI", "NIRv",
              "kNDVI", "LST_Day", "LST_Night", "Lai", "Fpar", "CSIF-SIFdaily", "CSIF-SIFinst",
              "BESS-PAR", "BESS-RSDN", "BESS-PARdiff", "ESACCI-sm", "ET", "MODIS_LC"],
    "rs_meteo": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "LST_Day", "LST_Night", "Lai", "Fpar",
                 "CSIF-SIFdaily", "CSIF-SIFinst", "BESS-PAR", "BESS-RSDN", "BESS-PARdiff",
                 "ESACCI-sm", "ET", "total_precipitation", "temperature_2m", "vpd", "prcp-lag3",
                 "MODIS_LC"],
    "rs_meteo_yr": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "LST_Day", "LST_Night", "Lai",
                    "Fpar", "CSIF-SIFdaily", "CSIF-SIFinst", "BESS-PAR", "BESS-RSDN",
                    "BESS-PARdiff", "ESACCI-sm", "ET", "total_precipitation", "temperature_2m",
                    "vpd", "prcp-lag3", "year", "MODIS_LC"],
    "model0": ["BESS-PAR", "BESS-PARdiff", "BESS-RSDN", "PET", "Ts", "Tmean", "prcp", "vpd",
               "prcp-lag3", "ESACCI-sm", "ET", "b1", "b2", "b3", "b4", "b5", "b6", "b7", "EVI",
               "NDVI", "GCI", "NDWI", "NIRv", "kNDVI", "CSIF-SIFdaily", "Percent_Snow", "Fpar",
               "Lai", "LST_Day", "LST_Night", "MODIS_LC"],
    "model1": ["BESS-PAR", "BESS-PARdiff", "BESS-RSDN", "PET", "Ts", "Tmean", "prcp", "vpd",
               "prcp-lag3", "ESACCI-sm", "ET", "b1", "b2", "b3", "b4", "b5", "b6", "b7", "EVI",
               "NDVI", "GCI", "NDWI", "NIRv", "kNDVI", "CSIF-SIFdaily", "Percent_Snow", "Fpar",
               "Lai", "LST_Day", "LST_Night", "MODIS_LC", "year"],
    "model2": ["BESS-PAR", "BESS-PARdiff", "BESS-RSDN", "PET", "Ts", "Tmean", "prcp", "vpd",
               "prcp-lag3", "ESACCI-sm", "ET", "b1", "b2", "b3", "b4", "b5", "b6", "b7", "EVI",
               "NDVI", "GCI", "NDWI", "NIRv", "kNDVI", "CSIF-SIFdaily", "Percent_Snow", "Fpar",
               "Lai", "LST_Day", "LST_Night", "MODIS_LC", "CO2_concentration", "year"],
}

# Model feature name -> name in the covariate store.
FEATURE_ALIASES = {"BESS-PAR": "BESS_PAR", "BESS-PARdiff": "BESS_PARdiff",
                   "BESS-RSDN": "BESS_RSDN", "MODIS_LC": "IGBP"}

# Reanalysis band renames.
REANALYSIS_RENAMES = {"temperature_2m": "Tmean", "potential_evaporation": "PET",
                      "skin_temperature": "Ts",
                      "evaporation_from_vegetation_transpiration": "transpiration",
                      "dewpoint_temperature_2m": "dewpoint", "total_precipitation": "prcp"}

# Covariate datasets and the variables each one holds.
COVARIATE_DATASETS = {
    "ALEXI": ["ET"],
    "BESS_Rad": ["BESS_PAR", "BESS_PARdiff", "BESS_RSDN"],
    "CSIF": ["CSIF-SIFdaily", "CSIF-SIFinst"],
    "ESA_CCI": ["ESACCI-sm"],
    "MCD12Q1": ["IGBP"],
    "MCD43C4v006": ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "EVI", "GCI", "NDVI", "NDWI",
                    "NIRv", "kNDVI"],
    "MODIS_LAI": ["Fpar", "Lai"],
    "MODIS_LST": ["LST_Day", "LST_Night"],
}

# Two-tailed Nemenyi q at alpha 0.05 for 2..20 treatments (Demsar 2006).
NEMENYI_Q05 = {2: 1.959964, 3: 2.343701, 4: 2.569032, 5: 2.727774, 6: 2.849705, 7: 2.948320,
               8: 3.030879, 9: 3.101730, 10: 3.163684, 11: 3.218654, 12: 3.268004, 13: 3.312739,
               14: 3.353618, 15: 3.391230, 16: 3.426041, 17: 3.458425, 18: 3.488685,
               19: 3.517073, 20: 3.543799}
