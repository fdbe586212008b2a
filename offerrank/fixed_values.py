"""Fixed values.

Everything in this module must equal the documented business values for the
results to be right: labels, bin edges, catalog rows, thresholds, phrases and
text formats. It holds data only; the code that uses it lives elsewhere.
"""

# --- category values, in the alphabetical order of the output columns --------
CLAIM_TYPES = [
    "emergency", "imaging", "inpatient", "lab", "outpatient",
    "preventive", "primary_care", "procedure", "specialist",
]
DIAGNOSES = [
    "cardiovascular", "dermatological", "diabetes", "endocrine",
    "gastrointestinal", "general_wellness", "mental_health",
    "musculoskeletal", "neurological", "oncology", "respiratory",
]
# diagnoses that get a has_<name> flag, in output order
FLAGGED_DIAGNOSES = [
    "diabetes", "cardiovascular", "respiratory", "mental_health",
    "musculoskeletal", "gastrointestinal", "neurological", "oncology",
]
BENEFIT_TYPES = [
    "dental", "medical", "mental_health", "pharmacy", "preventive",
    "telehealth", "vision",
]
CHANNELS = ["app", "email", "mail", "phone", "portal", "sms"]
ENGAGEMENT_TYPES = [
    "app_open", "appointment_schedule", "content_view", "offer_click",
    "offer_view", "portal_login", "survey_complete",
]

# --- bins: right-closed (low, high]; a value outside every bin is "nan" ------
AGE_BINS = [0, 26, 35, 50, 65, 100]
AGE_LABELS = ["18-25", "26-35", "36-50", "51-65", "65+"]
TENURE_BINS = [0, 12, 24, 60, 120, 300]
TENURE_LABELS = ["<1yr", "1-2yr", "2-5yr", "5-10yr", "10yr+"]
REPORT_AGE_BINS = [0, 35, 50, 65, 100]
REPORT_AGE_LABELS = ["<35", "35-50", "50-65", "65+"]

# --- thresholds of the derived features --------------------------------------
SENIOR_AGE = 65
NEW_MEMBER_MONTHS = 12
HIGH_RISK_SCORE = 70
COMPLEX_DIAGNOSES = 3
CLAIM_WINDOWS = [30, 90, 180, 365]
ENGAGEMENT_WINDOWS = [30, 90]
OPEN_ENROLLMENT_MONTHS = [10, 11, 12]
FLU_MONTHS = [10, 11, 12, 1, 2, 3]
ALLERGY_MONTHS = [3, 4, 5, 9, 10]
NO_ACTIVITY_DAYS = 365

# --- missing-value policy: first pattern found in the column name wins -------
FILL_POLICY = [
    (("count", "total"), "zero"),
    (("rate", "pct"), "median"),
    (("days_since",), "no_activity"),
    (("",), "zero"),
]

# --- feature groups: a feature belongs to every group whose word it contains -
FEATURE_GROUPS = {
    "demographic": ["age", "gender", "region", "plan", "tenure", "income",
                    "family", "senior", "new_member"],
    "claims": ["claim", "visit", "paid", "cost"],
    "diagnosis": ["has_", "diagnosis", "chronic", "complex", "risk"],
    "benefits": ["benefit", "utilization", "deductible", "remaining"],
    "engagement": ["engagement", "response", "session", "channel", "portal",
                   "app", "email", "phone"],
    "temporal": ["month", "quarter", "season", "year_end", "urgency"],
}

# --- correlation inputs -------------------------------------------------------
MEMBER_CORRELATION_COLUMNS = [
    "age", "tenure_months", "family_size", "risk_score",
    "chronic_condition_count", "claim_count", "total_claim_amount",
]
FEATURE_CORRELATION_COLUMNS = [
    "age", "tenure_months", "risk_score", "chronic_condition_count",
    "total_claims_count", "total_claims_amount", "claims_last_90d",
    "has_diabetes", "has_cardiovascular", "has_mental_health",
    "avg_utilization_rate", "pharmacy_utilization_rate", "total_engagements",
    "avg_response_rate", "days_since_last_claim", "is_senior",
    "high_risk_flag", "is_complex_patient",
]
HISTOGRAM_FEATURES = [
    "age", "tenure_months", "risk_score", "chronic_condition_count",
    "total_claims_count", "total_claims_amount", "avg_claim_amount",
    "avg_utilization_rate", "total_engagements", "avg_response_rate",
]
LOG_HISTOGRAM_FEATURES = ["total_claims_count", "total_claims_amount"]
HISTOGRAM_CLAIM_CAP = 5000.0

# --- offer catalog: id, name, category, base score, description, weight,
#     target conditions. Position is the tie-break order. ---------------------
OFFERS = [
    ("PREV_001", "Annual Wellness Visit Reminder", "preventive_care", 60.0,
     "Schedule your free annual wellness visit", 1.2, ["general"]),
    ("PREV_002", "Cancer Screening Program", "preventive_care", 55.0,
     "Age-appropriate cancer screenings covered at 100%", 1.3,
     ["general", "high_risk"]),
    ("CHRON_001", "Diabetes Management Program", "chronic_disease", 50.0,
     "Comprehensive diabetes care and monitoring", 1.5,
     ["diabetes", "prediabetes"]),
    ("CHRON_002", "Heart Health Program", "chronic_disease", 50.0,
     "Cardiovascular disease prevention and management", 1.5,
     ["cardiovascular", "hypertension"]),
    ("CHRON_003", "Respiratory Care Program", "chronic_disease", 50.0,
     "Asthma and COPD management support", 1.4, ["respiratory"]),
    ("MH_001", "Mental Health Support", "mental_health", 55.0,
     "Access to counseling and therapy services", 1.3,
     ["mental_health", "stress"]),
    ("MH_002", "Stress Management Workshop", "mental_health", 50.0,
     "Virtual stress reduction and mindfulness programs", 1.1,
     ["stress", "general"]),
    ("PHARM_001", "Generic Drug Switch Program", "pharmacy", 45.0,
     "Save money by switching to generic medications", 1.2, ["high_rx_cost"]),
    ("PHARM_002", "Mail-Order Pharmacy", "pharmacy", 45.0,
     "90-day supply with home delivery savings", 1.1, ["chronic_rx"]),
    ("TELE_001", "Virtual Primary Care", "telehealth", 50.0,
     "24/7 access to virtual doctor visits", 1.0, ["general", "convenience"]),
    ("TELE_002", "Virtual Specialist Consultations", "telehealth", 45.0,
     "Connect with specialists from home", 1.2, ["specialist_need"]),
    ("FIT_001", "Gym Membership Discount", "fitness", 40.0,
     "50% off gym memberships nationwide", 0.9,
     ["fitness", "weight_management"]),
    ("FIT_002", "Nutrition Coaching", "fitness", 45.0,
     "Personalized nutrition plans and coaching", 1.1,
     ["weight_management", "diabetes"]),
    ("NAV_001", "Care Navigator Assignment", "care_navigation", 40.0,
     "Personal care coordinator for complex conditions", 1.4,
     ["complex_care", "multiple_chronic"]),
    ("COST_001", "HSA/FSA Optimization", "cost_savings", 45.0,
     "Maximize your tax-advantaged health savings", 1.0, ["high_oop_cost"]),
    ("COST_002", "In-Network Provider Finder", "cost_savings", 45.0,
     "Find quality in-network providers to reduce costs", 1.1,
     ["high_oop_cost", "oon_usage"]),
]

# --- targeting rules: offer, rule name, kind, threshold, boost ---------------
# min: value >= threshold adds boost; max: value <= threshold adds boost;
# scale: value * boost is added.
OFFER_RULES = [
    ("PREV_001", "age_boost", "min", 40.0, 10.0),
    ("PREV_001", "days_since_last_claim_boost", "min", 180.0, 15.0),
    ("PREV_001", "has_chronic_condition_boost", "scale", None, 10.0),
    ("PREV_002", "age_boost", "min", 50.0, 20.0),
    ("PREV_002", "high_risk_flag_boost", "scale", None, 15.0),
    ("CHRON_001", "has_diabetes_boost", "scale", None, 40.0),
    ("CHRON_001", "high_risk_flag_boost", "scale", None, 10.0),
    ("CHRON_001", "pharmacy_utilization_boost", "min", 0.3, 5.0),
    ("CHRON_002", "has_cardiovascular_boost", "scale", None, 40.0),
    ("CHRON_002", "age_boost", "min", 50.0, 10.0),
    ("CHRON_002", "high_risk_flag_boost", "scale", None, 10.0),
    ("CHRON_003", "has_respiratory_boost", "scale", None, 40.0),
    ("CHRON_003", "is_allergy_season_boost", "scale", None, 5.0),
    ("MH_001", "has_mental_health_boost", "scale", None, 35.0),
    ("MH_001", "age_boost", "max", 45.0, 10.0),
    ("MH_001", "engagement_trend_boost", "min", 0.5, 5.0),
    ("MH_002", "total_claims_count_boost", "min", 10.0, 10.0),
    ("MH_002", "avg_response_rate_boost", "min", 0.2, 10.0),
    ("PHARM_001", "pharmacy_utilization_rate_boost", "min", 0.4, 20.0),
    ("PHARM_001", "total_member_cost_boost", "min", 500.0, 15.0),
    ("PHARM_002", "pharmacy_utilization_rate_boost", "min", 0.3, 15.0),
    ("PHARM_002", "has_chronic_condition_boost", "scale", None, 10.0),
    ("TELE_001", "app_engagement_rate_boost", "min", 0.2, 15.0),
    ("TELE_001", "primary_care_visit_count_boost", "min", 2.0, 10.0),
    ("TELE_002", "specialist_visit_count_boost", "min", 2.0, 20.0),
    ("TELE_002", "is_complex_patient_boost", "scale", None, 15.0),
    ("FIT_001", "age_boost", "max", 55.0, 10.0),
    ("FIT_001", "has_cardiovascular_boost", "scale", None, 10.0),
    ("FIT_001", "has_diabetes_boost", "scale", None, 10.0),
    ("FIT_002", "has_diabetes_boost", "scale", None, 15.0),
    ("FIT_002", "has_cardiovascular_boost", "scale", None, 10.0),
    ("FIT_002", "high_risk_flag_boost", "scale", None, 10.0),
    ("NAV_001", "is_complex_patient_boost", "scale", None, 30.0),
    ("NAV_001", "total_claims_count_boost", "min", 15.0, 15.0),
    ("NAV_001", "chronic_condition_count_boost", "min", 2.0, 10.0),
    ("COST_001", "remaining_deductible_pct_boost", "min", 0.5, 15.0),
    ("COST_001", "is_q4_boost", "scale", None, 20.0),
    ("COST_002", "in_network_rate_boost", "max", 0.8, 20.0),
    ("COST_002", "total_member_cost_boost", "min", 500.0, 10.0),
]

# --- feedback settings --------------------------------------------------------
APPROVED_BOOST = 15.0
REJECTED_PENALTY = -20.0
FEEDBACK_WEIGHT = 0.3
FEEDBACK_SAMPLE_WEIGHT = 2.0
MIN_FEEDBACK_COUNT = 10
R2_IMPROVEMENT = 0.01

# --- boosted-tree settings ----------------------------------------------------
TREE_SETTINGS = {"rounds": 200, "learning_rate": 0.05, "leaves": 31,
                 "feature_fraction": 0.8, "row_fraction": 0.8, "seed": 42}

# --- column names of the marketing platforms ---------------------------------
PLATFORM_COLUMNS = {
    "salesforce": {"member_id": "ContactId", "offer_id": "CampaignMemberId",
                   "priority_score": "Score__c", "offer_name": "OfferName__c"},
    "marketo": {"member_id": "leadId", "offer_id": "programId",
                "priority_score": "score", "offer_name": "programName"},
}
CAMPAIGN_TYPE = "healthcare_offers"
CAMPAIGN_ID = "HEALTH_OFFERS_Q4_2024"

# --- reader-facing factor names: first phrase contained in the name wins -----
FACTOR_PHRASES = [
    ("phone engagement rate", "Phone outreach response"),
    ("call engagement rate", "Phone outreach response"),
    ("email engagement rate", "Email engagement"),
    ("app engagement rate", "Mobile app engagement"),
    ("portal login count", "Portal activity"),
    ("total engagements", "Engagement with health programs"),
    ("days since last engagement", "Time since last interaction"),
    ("avg response rate", "Response to outreach"),
    ("chronic condition count", "Number of chronic conditions"),
    ("total claims count", "Healthcare claims history"),
    ("claims last", "Recent claims activity"),
    ("days since last claim", "Time since last healthcare visit"),
    ("er visit count", "Emergency room visits"),
    ("inpatient count", "Hospital stays"),
    ("specialist visit count", "Specialist consultations"),
    ("preventive visit count", "Preventive care visits"),
    ("avg utilization rate", "Benefits utilization level"),
    ("pharmacy utilization rate", "Prescription medication usage"),
    ("medical utilization rate", "Medical services usage"),
    ("preventive utilization rate", "Preventive care usage"),
    ("mental health utilization rate", "Mental health services usage"),
    ("remaining deductible pct", "Remaining deductible"),
    ("remaining oop max pct", "Out-of-pocket spending room"),
    ("total member cost", "Healthcare spending"),
    ("risk score", "Health risk assessment"),
    ("tenure months", "Membership duration"),
    ("is senior", "Senior member status"),
    ("is complex patient", "Complex health needs"),
    ("high risk", "Elevated health risk"),
]

# --- reader-facing factor sentences, keyed by case and direction -------------
# {n} is an integer taken from the member profile, {level} a risk level.
FACTOR_SENTENCES = {
    ("phone", True): "Their phone engagement shows strong receptivity to phone outreach.",
    ("phone", False): "Their phone engagement suggests trying different communication channels.",
    ("email", True): "Their email engagement shows strong receptivity to email communications.",
    ("email", False): "Their email engagement suggests trying different communication channels.",
    ("digital", True): "Their digital engagement shows strong receptivity to digital channels.",
    ("digital", False): "Their digital engagement suggests trying different communication channels.",
    ("response", True): "Their responsiveness to outreach suggests they'll engage with this offer.",
    ("response", False): "Their response patterns indicate we may need different messaging approaches.",
    ("program", True): "Their program engagement shows strong receptivity to health programs.",
    ("program", False): "Their program engagement suggests trying different communication channels.",
    ("odd age", True): "Their age demographic makes this offer particularly relevant.",
    ("odd age", False): "Based on their age group, other offers may be more relevant.",
    ("age", True): "At age {n}, this member is in a key demographic for this offer's benefits.",
    ("age", False): "At age {n}, other offers may be more relevant to their life stage.",
    ("risk", True): "Their {level} risk profile indicates this offer could provide meaningful health support.",
    ("risk", False): "Their {level} risk profile suggests other programs may be better suited.",
    ("diabetes", True): "Their diabetes diagnosis makes this program particularly relevant for their care needs.",
    ("diabetes", False): "While they have diabetes, other factors suggest different priorities.",
    ("no diabetes", True): "No diabetes diagnosis on record.",
    ("no diabetes", False): "No diabetes diagnosis on record.",
    ("heart", True): "Their heart health history makes this program especially beneficial.",
    ("heart", False): "Heart health is a consideration, but other factors take priority here.",
    ("no heart", True): "No cardiovascular conditions on record.",
    ("no heart", False): "No cardiovascular conditions on record.",
    ("many chronic", True): "Managing {n} chronic conditions, they can benefit from comprehensive support.",
    ("some chronic", True): "With {n} chronic condition(s), this targeted support is relevant.",
    ("some chronic", False): "Their {n} condition(s) are considered, but other factors matter more here.",
    ("no chronic", True): "No chronic conditions on record.",
    ("no chronic", False): "No chronic conditions on record.",
    ("claims", True): "Their healthcare activity ({n} claims) shows engagement with their health.",
    ("claims", False): "Their claims history ({n}) suggests other approaches may resonate more.",
    ("no claims", True): "Their healthcare activity shows engagement with their health.",
    ("no claims", False): "Their claims history suggests other approaches may resonate more.",
    ("other", True): "This factor positively supports this recommendation.",
    ("other", False): "This factor was considered in the overall assessment.",
}
RISK_LEVELS = [(60.0, "elevated"), (30.0, "moderate"), (None, "lower")]
PLAUSIBLE_AGES = (18, 120)
MANY_CHRONIC = 2

# --- member segments, strongest first ----------------------------------------
SEGMENTS = ["Seniors", "New Members", "High Utilizers", "Active Engagers",
            "High-Risk Chronic", "Standard"]
UTILIZER_QUANTILE = 0.9
ENGAGER_QUANTILE = 0.75
ENGAGER_RESPONSE = 0.3
CHRONIC_CONDITIONS = 2
CHRONIC_RISK = 50.0

# --- text blocks of the explanation prompt -----------------------------------
PROMPT_HEAD = (
    "You are a healthcare benefits advisor writing personalized explanations "
    "for offer recommendations.\n\n"
    "Based on the member profile and the key factors that influenced this "
    "recommendation, write a 3-4 sentence \n"
    "explanation for why this offer is being recommended. Be specific about "
    "how the member's characteristics \n"
    "make this offer relevant. Use a warm, supportive, and professional tone."
)
PROMPT_TAIL = (
    "Write a 3-4 sentence personalized explanation for why this offer is "
    "recommended for this member. \n"
    "Do not use bullet points. Do not mention scores or technical details. "
    "Focus on the member's health needs."
)
MEMBER_TEXT_RULER = "=" * 50
SUMMARY_PROMPT = (
    "\nYou are a healthcare benefits advisor. Based on the member profile and "
    "recommended offers below,\n"
    "write a personalized summary explaining why each offer is relevant for "
    "this member.\n\n"
    "Use a warm, supportive tone. Focus on how each offer addresses the "
    "member's specific health needs\n"
    "and circumstances. Keep explanations concise (2-3 sentences per offer).\n\n"
    "MEMBER DATA:\n{member_json}\n\n"
    "Please write a personalized summary for this member explaining their top "
    "recommended offers\n"
    "and why each one is particularly relevant for them.\n"
)
