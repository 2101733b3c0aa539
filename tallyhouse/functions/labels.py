"""Category labels of the HUD case-data standard and of the reports.

Fixed values: results depend on these exact texts.
"""

# --- race and ethnicity -----------------------------------------------------

BIPOC_RACES = (
    "Native Hawaiian or Pacific Islander (HUD)",
    "Black, African American, or African (HUD)",
    "Other Multi-Racial",
    "Other",
    "American Indian, Alaska Native, or Indigenous (HUD)",
    "Asian or Asian American (HUD)",
)

BIPOC_RACES_OLD = (
    "Black or African American (HUD)",
    "Native Hawaiian or Other Pacific Islander (HUD)",
    "Other Multi-Racial",
    "American Indian or Alaska Native (HUD)",
    "Other",
    "Asian (HUD)",
)

BIPOC_CENSUS_RACES = (
    "Native Hawaiian or Other Pacific Islander (HUD)",
    "Two or More Races",
    "Other",
    "Black or African American (HUD)",
    "American Indian or Alaska Native (HUD)",
    "Asian (HUD)",
    "Native Hawaiian or Pacific Islander (HUD)",
    "Black, African American, or African (HUD)",
    "Asian or Asian American (HUD)",
    "American Indian, Alaska Native, or Indigenous (HUD)",
)

HISPANIC = "Hispanic/Latin(a)(o)(x) (HUD)"
HISPANIC_OLD = "Hispanic/Latino (HUD)"
WHITE = "White (HUD)"
MULTI_RACIAL = "Other Multi-Racial"
TWO_OR_MORE = "Two or More Races"
WHITE_NON_HISPANIC = "White, Non-Hispanic"

RACE_LEVELS = (
    WHITE_NON_HISPANIC,
    "Native Hawaiian or Pacific Islander (HUD)",
    "Black, African American, or African (HUD)",
    TWO_OR_MORE,
    "American Indian, Alaska Native, or Indigenous (HUD)",
    "Asian or Asian American (HUD)",
)

# --- client list ------------------------------------------------------------

NEWLY_HOMELESS = "Newly Homeless"
HOUSED = "Housed"
ACTIVE_STATUSES = ("Return from Housed", "Active", "Newly Homeless", "Return from Inactive")

TRANS_WOMAN = "Trans Woman"
TRANS_MAN = "Trans Man"
NON_BINARY = "Non Binary"
FEMALE = "Female"
MALE = "Male"
GENDER_UNKNOWN = ("Client refused", "Data not collected")
WOMEN_AND_NON_BINARY = (FEMALE, NON_BINARY, TRANS_WOMAN)

AGE_BUCKETS = (
    ("0 - 5", 5),
    ("6 – 11", 11),
    ("12 – 17", 17),
    ("18 – 24", 24),
    ("25 – 34", 34),
    ("35 – 44", 44),
    ("45 – 54", 54),
    ("55 – 69", 69),
    ("70+", None),
)
UNKNOWN = "Unknown"
AGE_LEVELS = tuple(label for label, _ in AGE_BUCKETS) + (UNKNOWN,)

# --- relationship to the head of household -----------------------------------

RELATIONSHIPS = {
    "Self": ("Self (head of household)",),
    "Child": (
        "Head of household's child",
        "non-binary child",
        "daughter",
        "son",
        "adult daughter",
        "adult son",
        "step-son",
        "step-daughter",
        "son-in-law",
        "daughter-in-law",
        "child of partner",
    ),
    "Partner": ("Head of household's spouse or partner", "partner", "husband", "wife"),
    "Sibling": ("step-brother", "brother", "sister", "step-sister"),
    "Parent": ("father", "mother", "father-in-law", "mother-in-law", "step-father"),
    "Grandchild": ("granddaughter", "grandson"),
    "Grandparent": ("grandfather", "grandmother"),
    "Other Relative": (
        "uncle",
        "niece",
        "nephew",
        "other relative",
        "cousin",
        "aunt",
        "Head of household's other relation member (other relation to head of household)",
    ),
    "Unknown": (
        "other non-relative",
        "unknown",
        "friend of family",
        "Data not collected",
        "Other: non-relation member",
    ),
}

HOUSEHOLD_TYPES = (
    "Family With Children",
    "Single Female",
    "Single Male",
    "Single Person - Gender Unknown",
    "Single Non-Binary Person",
    "Couple",
    "Household with Adult Child/ren",
    "Household with Child/ren, Age Unknown",
    "Other Familial Relationship",
    "Adults Only, Relationship Unknown",
    "Cannot Determine",
)

# --- calls ------------------------------------------------------------------

VETERAN_YES = "Yes (HUD)"
LITERALLY = "Literally Homeless"
NOT_LITERALLY = "Not Literally Homeless"

SHELTER_CODES = ("Homeless Motel Vouchers", "Emergency Shelter", "Domestic Violence Shelters")

LITERAL_CODES = ("Coordinated Entry (all literally homeless)",)

LITERAL_SITUATIONS = (
    "Place not meant for habitation (HUD)",
    "Emergency shelter, incl. hotel/motel paid for w/ ES voucher, or RHY-funded Host Home shelter (HUD)",
    "Domestic Violence Situation",
    "Homeless/on the Street",
    "Safe Haven (HUD)",
    "Transitional housing for homeless persons (including homeless youth) (HUD)",
)

HOUSED_CODES = (
    "Prevention - Available (at-risk of homelessness, may refer)",
    "Prevention - Not Available (at-risk of homelessness, no referral possible)",
    "Prevention - ERAP (CARES money)",
    "Information Only (not literally homeless or at-risk)",
)

HOUSED_SITUATIONS = (
    "Jail, prison or juvenile detention facility (HUD)",
    "Psychiatric hospital or other psychiatric facility (HUD)",
    "Substance abuse treatment facility or detox center (HUD)",
    "Rental by client, no ongoing housing subsidy (HUD)",
    "Staying or living in a friend's room, apartment or house (HUD)",
    "Staying or living in a family member's room, apartment or house (HUD)",
    "Owned by client, no ongoing housing subsidy (HUD)",
    "Rental by client, with VASH housing subsidy (HUD)",
    "Rental by client, with other ongoing housing subsidy (HUD)",
    "Hotel or motel paid for without emergency shelter voucher (HUD)",
    "Residential project or halfway house with no homeless criteria (HUD)",
    "Rental by client in a public housing unit (HUD)",
    "Hospital or other residential non-psychiatric medical facility (HUD)",
    "Foster care home or foster care group home (HUD)",
    "Rental by client, with RRH or equivalent subsidy (HUD)",
    "Owned by client, with ongoing housing subsidy (HUD)",
    "Permanent housing (other than RRH) for formerly homeless persons (HUD)",
    "Rental by client, with HCV voucher (tenant or project based) (HUD)",
    "Long-term care facility or nursing home (HUD)",
    "Group home (not foster care)",
    "Rental by client, with GPD TIP housing subsidy (HUD)",
    "Interim Housing (HUD) (Retired)",
)

PROBABLY_LITERAL_CODES = (
    "Housing Related Coordinated Entry",
    "Emergency Shelter",
    "Homeless Motel Vouchers",
    "Homeless Safe Parking Programs",
    "Domestic Violence Shelters",
    "Animal Shelters",
)

PROBABLY_HOUSED_CODES = ("Rent Payment Assistance", "Homelessness Prevention Programs")

# --- programs ---------------------------------------------------------------

EMERGENCY_SHELTER = "Emergency Shelter (HUD)"
DIVERSION = "Diversion"
COORDINATED_ENTRY = "Coordinated Entry (HUD)"
PREVENTION = "Homelessness Prevention (HUD)"
HOUSING_PROGRAMS = (
    "Transitional housing (HUD)",
    "PH - Rapid Re-Housing (HUD)",
    "PH - Permanent Supportive Housing (disability required for entry) (HUD)",
)
PERMANENT = "Permanent Situation"
