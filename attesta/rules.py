"""The default rule set. Every operator takes its rules as an argument; these are the defaults.

All values below are fixed values: results are only comparable when they stay exactly as given.
"""

READING_VERSION = "read-1.1"
RULES_VERSION = "rules-1.2"

# ---- Fixed values: classification phrases (phrase, weight) per document type ----
CLASSIFY_RULES = [
    ("BIR_2303", "CERTIFICATE OF REGISTRATION", 2.0),
    ("BIR_2303", "BIR FORM", 2.0),
    ("BIR_2303", "2303", 1.5),
    ("BIR_2303", "TIN BRANCH CODE", 3.0),
    ("BIR_2303", "NAME OF TAXPAYER", 3.0),
    ("BIR_2303", "RENTAS INTERNAS", 2.0),
    ("BIR_2303", "REVENUE DISTRICT OFFICE", 2.0),
    ("BIR_2303", "TAXPAYER TYPE", 2.0),
    ("BIR_2303", "FILING FREQUENCY", 1.0),
    ("DTI_BN_CERT", "BUSINESS NAME REGISTRATION", 4.0),
    ("DTI_BN_CERT", "BUSINESS NAME NO", 3.0),
    ("DTI_BN_CERT", "ACT 3883", 3.0),
    ("DTI_BN_CERT", "REPUBLIC ACT NO 863", 2.0),
    ("DTI_BN_CERT", "DEPARTMENT OF TRADE", 2.0),
    ("DTI_BN_CERT", "THIS CERTIFICATE ISSUED TO", 2.0),
    ("DTI_BN_CERT", "NOT A LICENSE TO ENGAGE", 2.0),
    ("MAYORS_PERMIT", "MAYORS PERMIT", 4.0),
    ("MAYORS_PERMIT", "MAYORS BUSINESS PERMIT", 4.0),
    ("MAYORS_PERMIT", "BUSINESS PERMIT", 2.0),
    ("MAYORS_PERMIT", "BUSINESS LICENSE", 2.0),
    ("MAYORS_PERMIT", "PERMIT NO", 1.5),
    ("MAYORS_PERMIT", "LINE OF BUSINESS", 1.0),
    ("MAYORS_PERMIT", "NATURE OF BUSINESS", 1.0),
    ("MAYORS_PERMIT", "MUNICIPAL TAX ORDINANCE", 2.0),
    ("MAYORS_PERMIT", "CITY MAYOR", 2.0),
    ("MAYORS_PERMIT", "PROPRIETOR", 1.0),
    ("MAYORS_PERMIT", "LOCAL GOVERNMENT CODE", 1.0),
    ("MAYORS_PERMIT", "PAHINTULOT SA PANGANGALAKAL", 4.0),
    ("MAYORS_PERMIT", "BUSINESS PERMITS OFFICE", 2.0),
    ("MAYORS_PERMIT", "BUSINESS PERMITS AND LICENSING", 2.0),
    ("MAYORS_PERMIT", "PUNONG LUNGSOD", 2.0),
    ("MAYORS_PERMIT", "PERMIT TO OPERATE", 2.0),
    ("SEC_CERT", "SECURITIES AND EXCHANGE COMMISSION", 4.0),
    ("SEC_CERT", "CERTIFICATE OF INCORPORATION", 4.0),
    ("SEC_CERT", "ARTICLES OF INCORPORATION", 2.0),
    ("SEC_CERT", "SEC REGISTRATION NO", 3.0),
    ("GIS", "GENERAL INFORMATION SHEET", 5.0),
    ("GIS", "STOCKHOLDERS", 1.5),
    ("GIS", "DIRECTORS OFFICERS", 1.5),
    ("BARANGAY_CLEARANCE", "BARANGAY CLEARANCE", 4.0),
    ("BARANGAY_CLEARANCE", "BARANGAY BUSINESS CLEARANCE", 5.0),
    ("BARANGAY_CLEARANCE", "PUNONG BARANGAY", 2.0),
    ("BARANGAY_CLEARANCE", "TANGGAPAN NG PUNONG BARANGAY", 2.0),
    ("GOVERNMENT_ID", "DRIVERS LICENSE", 4.0),
    ("GOVERNMENT_ID", "PHILIPPINE IDENTIFICATION", 4.0),
    ("GOVERNMENT_ID", "PHILSYS", 4.0),
    ("GOVERNMENT_ID", "PAMBANSANG PAGKAKAKILANLAN", 4.0),
    ("GOVERNMENT_ID", "UNIFIED MULTIPURPOSE ID", 4.0),
    ("GOVERNMENT_ID", "SOCIAL SECURITY SYSTEM", 3.0),
    ("GOVERNMENT_ID", "PROFESSIONAL REGULATION COMMISSION", 4.0),
    ("GOVERNMENT_ID", "PASSPORT", 3.0),
    ("GOVERNMENT_ID", "POSTAL IDENTITY", 4.0),
    ("GOVERNMENT_ID", "VOTERS ID", 4.0),
    ("GOVERNMENT_ID", "DATE OF BIRTH", 2.0),
    ("GOVERNMENT_ID", "BIRTH DATE", 2.0),
    ("GOVERNMENT_ID", "ISSUE DATE", 1.0),
    ("GOVERNMENT_ID", "SIGNATURE", 1.0),
    ("GOVERNMENT_ID", "DEPARTMENT OF FINANCE", 1.0),
    ("GOVERNMENT_ID", "LICENSE NO", 2.0),
    ("FOOD_SAFETY_PERMIT", "NATIONAL MEAT INSPECTION", 4.0),
    ("FOOD_SAFETY_PERMIT", "FOOD AND DRUG ADMINISTRATION", 3.0),
    ("FOOD_SAFETY_PERMIT", "LICENSE TO OPERATE", 3.0),
    ("FOOD_SAFETY_PERMIT", "SANITARY PERMIT", 3.0),
    ("FOOD_SAFETY_PERMIT", "ACCREDITATION", 1.0),
]

# ---- Fixed values: file name hints ----
NAME_HINTS = [
    ("BIR_2303", "2303"), ("BIR_2303", "BIR"), ("BIR_2303", "COR"),
    ("DTI_BN_CERT", "DTI"),
    ("MAYORS_PERMIT", "PERMIT"), ("MAYORS_PERMIT", "MAYOR"),
    ("SEC_CERT", "SEC"),
    ("GIS", "GIS"),
    ("BARANGAY_CLEARANCE", "BRGY"), ("BARANGAY_CLEARANCE", "BARANGAY"),
    ("GOVERNMENT_ID", "ID"),
]
MIN_CLASS_SCORE = 3.0

# ---- Fixed values: fields per document type (name, kind, required, target_field, pattern) ----
FIELD_SPECS = {
    "BIR_2303": [
        ("tin", "tin", True, "Tax_Identification_Number_TIN", None),
        ("taxpayer_name", "name", True, None, None),
        ("trade_name", "name", False, "Invoice_Company_Name", None),
        ("registered_address", "address", True, "Billing_Street", None),
        ("taxpayer_type", "text", True, "Type_of_Business_Organization", None),
        ("registering_office", "choice", False, None, None),
        ("rdo_code", "code", False, None, None),
        ("tin_issuance_date", "date", False, None, None),
        ("registration_date", "date", False, None, None),
        ("line_of_business", "text", False, "Business_Style", None),
        ("psic", "text", False, None, None),
        ("ocn", "code", False, None, r"\d{3}RC\d{14}"),
    ],
    "DTI_BN_CERT": [
        ("business_name", "name", True, "Invoice_Company_Name", None),
        ("owner_name", "name", True, "Owner_Name", None),
        ("bn_number", "code", True, None, None),
        ("valid_from", "date", True, None, None),
        ("valid_to", "date", True, None, None),
        ("territorial_scope", "text", False, None, None),
        ("location", "address", False, None, None),
    ],
    "MAYORS_PERMIT": [
        ("business_name", "name", True, "Invoice_Company_Name", None),
        ("owner_name", "name", False, "Owner_Name", None),
        ("business_address", "address", False, "Billing_Street", None),
        ("permit_status", "text", False, None, None),
        ("permit_number", "code", True, None, None),
        ("permit_year", "number", True, None, None),
        ("line_of_business", "text", False, "Business_Style", None),
        ("issuing_lgu", "text", False, None, None),
        ("or_number", "code", False, None, None),
        ("amount_paid", "money", False, None, None),
        ("date_paid", "date", False, None, None),
        ("date_issued", "date", False, None, None),
        ("valid_until", "date", False, None, None),
        ("business_id", "code", False, None, None),
    ],
    "GOVERNMENT_ID": [
        ("id_type", "text", True, None, None),
        ("full_name", "name", True, None, None),
        ("id_number", "code", True, None, None),
        ("tin", "tin", False, None, None),
        ("address", "address", False, None, None),
        ("birth_date", "date", False, None, None),
        ("issue_date", "date", False, None, None),
        ("expiry_date", "date", False, None, None),
    ],
    # any other document type
    "*": [
        ("document_title", "text", True, None, None),
        ("business_name", "name", False, None, None),
        ("person_name", "name", False, None, None),
        ("document_number", "code", False, None, None),
        ("issue_date", "date", False, None, None),
        ("expiry_date", "date", False, None, None),
    ],
}

# ---- Fixed values: confidence by grounding and page quality, as rounded by the rule set ----
CONFIDENCE = {
    "EXACT": {"GOOD": 0.95, "FAIR": 0.85, "POOR": 0.71, "UNREADABLE": 0.57},
    "FUZZY": {"GOOD": 0.80, "FAIR": 0.72, "POOR": 0.60, "UNREADABLE": 0.48},
    "NOT_FOUND": {"GOOD": 0.50, "FAIR": 0.45, "POOR": 0.38, "UNREADABLE": 0.30},
    "UNVERIFIABLE": {"GOOD": 0.50, "FAIR": 0.45, "POOR": 0.38, "UNREADABLE": 0.30},
    "CONFLICT": {"GOOD": 0.30, "FAIR": 0.27, "POOR": 0.22, "UNREADABLE": 0.18},
}
QUALITY_ORDER = ["UNREADABLE", "POOR", "FAIR", "GOOD"]
FUZZY_MIN_RATIO = 0.85
EXACT_KINDS = ["tin", "code", "number", "money", "date"]
TYPED_KINDS = ["date", "tin", "money"]

# ---- Fixed values: form labels and their keys and kinds ----
FORM_TITLE = "CUSTOMER INFORMATION SHEET"
FORM_TYPE = "CUSTOMER_INFO_SHEET"
FORM_CONFIDENCE = 0.9
FORM_LABELS = {
    "date submitted": "date_submitted",
    "company name (legal entity)": "company_name",
    "business style / trade name": "business_style",
    "display name (on sales document)": "display_name",
    "customer type": "customer_type",
    "tin (incl. branch code)": "tin",
    "vat type": "vat_type",
    "sec / dti reg. no.": "registration_no",
    "industry / business nature": "industry",
    "years in operation": "years_in_operation",
    "billing address": "billing_address",
    "delivery address (if different)": "delivery_address",
    "city / province": "city_province",
    "zip code": "zip_code",
    "requested credit term": "requested_credit_term",
    "payment method": "payment_method",
    "receiving person / department": "receiving_person",
    "primary contact person": "contact_person",
    "position / department": "contact_position",
    "email address": "email",
    "mobile / landline (multiple)": "phone",
    "backup contact person": "backup_contact_person",
    "backup email / number": "backup_contact",
    "receiver 1 — full name": "receiver_1",
    "receiver 2 — full name": "receiver_2",
    "receiver 3 — full name": "receiver_3",
    "rg account manager/owner — name": "rg_account_manager",
}
FORM_KINDS = {
    "tin": "tin", "date_submitted": "date", "zip_code": "code", "registration_no": "code",
    "email": "email", "phone": "code", "company_name": "name", "business_style": "text",
    "display_name": "name", "contact_person": "name", "billing_address": "address",
    "delivery_address": "address",
}

# ---- Fixed values: address words ----
ADDRESS_ABBREVIATIONS = {
    "BLK": "BLOCK", "BL": "BLOCK", "LT": "LOT", "BRGY": "BARANGAY", "BGY": "BARANGAY",
    "BRG": "BARANGAY", "ST": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "RD": "ROAD",
    "PH": "PHASE", "SUBD": "SUBDIVISION", "VILL": "VILLAGE", "BLDG": "BUILDING",
    "FLR": "FLOOR", "EXT": "EXTENSION", "STO": "SANTO", "STA": "SANTA", "GEN": "GENERAL",
    "PROV": "PROVINCE", "MUN": "MUNICIPALITY", "FL": "FLOOR",
    "L": "LOT", "B": "BLOCK", "P": "PHASE",
}
ADDRESS_FILLERS = ["BARANGAY", "CITY", "OF", "PROVINCE", "MUNICIPALITY", "PHILIPPINES", "THE",
                   "DISTRICT", "NCR", "REGION", "AND"]
# (pattern, replacement), applied in this order to the upper-cased address
REGION_ALIASES = [
    (r"NATIONAL\s+CAPITAL\s+REGION\s*\(?\s*MANILA\s*\)?", " NCR "),
    (r"NATIONAL\s+CAPITAL\s+REGION", " NCR "),
    (r"METRO\s+MANILA", " NCR "),
    (r"\b(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH)\s+DISTRICT\b", " "),
    (r"\b(\d+)\s*(ST|ND|RD|TH)\b", " $1 "),
]
NAME_SUFFIXES = ["JR", "SR", "II", "III", "IV"]
LEGAL_SUFFIXES = r"\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|OPC|LTD|LIMITED)\b"

# ---- Fixed values: where each attribute comes from, in order of preference ----
SOURCE_RULES = [
    ("owner_name", "DTI_BN_CERT", "owner_name"),
    ("owner_name", "MAYORS_PERMIT", "owner_name"),
    ("owner_name", "GOVERNMENT_ID", "full_name"),
    ("owner_name", "BIR_2303", "taxpayer_name"),
    ("owner_name", "CUSTOMER_INFO_SHEET", "contact_person"),
    ("business_name", "DTI_BN_CERT", "business_name"),
    ("business_name", "BIR_2303", "trade_name"),
    ("business_name", "MAYORS_PERMIT", "business_name"),
    ("business_name", "CUSTOMER_INFO_SHEET", "company_name"),
    ("registered_name", "BIR_2303", "taxpayer_name"),
    ("tin", "BIR_2303", "tin"),
    ("tin", "GOVERNMENT_ID", "tin"),
    ("tin", "CUSTOMER_INFO_SHEET", "tin"),
    ("address", "BIR_2303", "registered_address"),
    ("address", "MAYORS_PERMIT", "business_address"),
    ("address", "CUSTOMER_INFO_SHEET", "billing_address"),
    ("email", "CUSTOMER_INFO_SHEET", "email"),
    ("phone", "CUSTOMER_INFO_SHEET", "phone"),
    ("contact_person", "CUSTOMER_INFO_SHEET", "contact_person"),
    ("taxpayer_type", "BIR_2303", "taxpayer_type"),
    ("line_of_business", "BIR_2303", "line_of_business"),
    ("line_of_business", "MAYORS_PERMIT", "line_of_business"),
]
EMAIL_LABEL = r"(?i)e-?mail"
PHONE_LABEL = r"(?i)tel|phone|mobile|cell|contact no"
OTHER_FIELD_CONFIDENCE = 0.8

# ---- Fixed values: how attributes are compared and how severe a conflict is ----
# attribute -> (position, matcher, severity, note)
CHECKED_ATTRIBUTES = {
    "owner_name": (0, "person", "CRITICAL", None),
    "business_name": (1, "business", "WARNING",
                      "Trade/brand names can differ from the registered name."),
    "registered_name": (2, "business", "WARNING", None),
    "tin": (3, "tin", "CRITICAL", None),
    "address": (4, "address", "INFO",
                "Business address and registered address can legitimately differ "
                "(e.g. branch or stall vs owner's residence)."),
    "email": (5, "email", "INFO", "A business can use several email addresses."),
    "phone": (6, "phone", "INFO", "A business can use several phone numbers."),
}

# ---- Fixed values: requirements, attachments, automatic updates ----
REQUIRED_DOCUMENTS = {
    "SOLE_PROPRIETORSHIP": ["BIR_2303", "DTI_BN_CERT", "MAYORS_PERMIT"],
    "CORPORATION": ["BIR_2303", "SEC_CERT", "MAYORS_PERMIT"],
    "PARTNERSHIP": ["BIR_2303", "SEC_CERT", "MAYORS_PERMIT"],
    "UNKNOWN": ["BIR_2303", "MAYORS_PERMIT"],
}
EXPIRED_REQUIRED_DOCUMENT = "INACTIVE"
EXPIRING_DOCUMENTS = ["MAYORS_PERMIT", "DTI_BN_CERT", "GOVERNMENT_ID", "BARANGAY_CLEARANCE",
                      "FOOD_SAFETY_PERMIT"]
FORM_TO_PICKLIST = {"SOLE_PROPRIETORSHIP": "Single Proprietorship", "PARTNERSHIP": "Partnership",
                    "CORPORATION": "Corporation"}
# (document type, account file field)
FILE_RULES = [
    ("MAYORS_PERMIT", "Business_Permit"),
    ("BIR_2303", "BIR_Registration_COR"),
    ("DTI_BN_CERT", "Business_registration"),
    ("SEC_CERT", "Business_registration"),
    ("GIS", "General_Information_Sheet"),
]
FILE_FIELDS = ["Business_Permit", "BIR_Registration_COR", "Business_registration",
               "General_Information_Sheet"]
MIN_CONFIDENCE = 0.6
# (target field, action, agreeing documents needed)
UPDATE_RULES = [
    ("Tax_Identification_Number_TIN", "FILL", 1), ("Tax_Identification_Number_TIN", "CORRECT", 2),
    ("Type_of_Business_Organization", "FILL", 1),
    ("Business_Style", "FILL", 1),
    ("Owner_Name", "FILL", 1), ("Owner_Name", "CORRECT", 2),
    ("Invoice_Company_Name", "FILL", 1), ("Invoice_Company_Name", "CORRECT", 2),
    ("Billing_Street", "FILL", 1),
]
AUTO_GROUNDINGS = ["EXACT", "CROSS_CHECKED"]
AUTO_THRESHOLD = 0.95
ACTIVE_VALUE = "Active"
ROLE_FIELDS = ["Contact_of", "Contact_Of", "Contact_Type", "Department", "Position_Role",
               "Contact_Category"]
PRIMARY_FIELDS = ["Account_Primary_Contact", "Primary_Contact"]
ACCOUNTING_ROLES = ["ACCOUNTING", "ACCOUTING"]
EXPIRY_FIELDS = {"DTI_BN_CERT": "valid_to", "MAYORS_PERMIT": "valid_until",
                 "GOVERNMENT_ID": "expiry_date"}
VALIDITY_CODES = ["EXPIRED", "NOT_YET_VALID", "VALIDITY_DERIVED", "UNUSUAL_VALIDITY_PERIOD",
                  "NO_EXPIRY_PRINTED"]
DATED_TYPES = ["DTI_BN_CERT", "MAYORS_PERMIT", "GOVERNMENT_ID", "BIR_2303"]

# ---- Fixed values: labels ----
DOCUMENT_LABELS = {
    "BIR_2303": "BIR Form 2303 (Certificate of Registration)",
    "DTI_BN_CERT": "DTI Business Name Certificate",
    "MAYORS_PERMIT": "Mayor's / Business Permit",
    "SEC_CERT": "SEC Certificate of Registration",
    "GIS": "General Information Sheet",
    "BARANGAY_CLEARANCE": "Barangay Clearance",
    "GOVERNMENT_ID": "Government ID",
    "FOOD_SAFETY_PERMIT": "Food safety permit (NMIS/FDA)",
}
SHORT_LABELS = {
    "BIR_2303": "BIR 2303", "DTI_BN_CERT": "DTI certificate", "MAYORS_PERMIT": "Mayor's permit",
    "SEC_CERT": "SEC certificate", "GOVERNMENT_ID": "government ID",
    "CUSTOMER_INFO_SHEET": "Customer Information Sheet",
    "BARANGAY_CLEARANCE": "barangay clearance", "FDA_LTO": "FDA license",
    "SANITARY_PERMIT": "sanitary permit",
}
FIELD_LABELS = {
    "Owner_Name": "Owner Name", "Tax_Identification_Number_TIN": "TIN",
    "Type_of_Business_Organization": "Type of Business Organization",
    "Invoice_Company_Name": "Invoice Company Name", "Business_Style": "Business Style",
    "Billing_Street": "Billing Street", "Account_Name": "Account Name",
    "Email": "Email", "Phone": "Phone",
    "Business_Permit": "Business Permit (file)",
    "BIR_Registration_COR": "BIR Registration COR (file)",
    "Business_registration": "Business Registration (file)",
}
CHECK_SHORT = {"payment_terms": "COD", "accounting_contact": "Contact", "tin": "TIN",
               "invoice_name": "Invoice name", "billing_address": "Address"}
NEEDS_DECISION = ["FILL", "CORRECT", "HOLD", "REVIEW_CONFLICT", "NO_PICKLIST_VALUE", "DIFFERS",
                  "ATTACH"]
AUTO_APPLIED = {"APPLIED": "Applied", "SHADOW": "Shadow", "SKIPPED_CHANGED": "Skipped",
                "FAILED": "Failed"}
OCR_VALUES = ["EXACT", "FUZZY", "CROSS_CHECKED", "NOT_FOUND", "CONFLICT", "UNVERIFIABLE"]
WRITABLE_FIELDS = ["Owner_Name", "Tax_Identification_Number_TIN", "Type_of_Business_Organization",
                   "Business_Style", "Invoice_Company_Name", "Billing_Street", "Account_Name",
                   "Email", "Phone"]
REVIEW_OPEN = ["Pending Review", "In Review"]
REVIEW_CLOSED = ["Applied", "Conflict", "Failed", "Rejected", "Waiting for Documents",
                 "No Action"]
DECISIONS = ["Pending", "Approve", "Edit", "Reject"]
ACTIVE_JOB_STATUSES = ["QUEUED", "COLLECTING", "COLLECTED", "READING", "EXTRACTING"]
MAX_REVIEW_ROWS = 25
EXPIRY_LEVELS = [0, 7, 30]

# ---- Fixed values: the account columns a snapshot keeps ----
SNAPSHOT_FIELDS = [
    "id", "Account_Name", "Invoice_Company_Name", "Inventory_Customer_Number",
    "Customer_Status", "Lead_Category", "Credit_Terms", "Owner", "Owner_Name", "Owner_Position",
    "Owner_Address", "Type_of_Business_Organization", "Business_Style",
    "Tax_Identification_Number_TIN", "Corp_Tax_Cert_No", "Billing_Street", "Billing_Barangay",
    "Billing_City", "Billing_City1", "Billing_Province", "Billing_State", "Billing_Code",
    "Billing_Country", "Shipping_Street", "Shipping_Barangay", "Shipping_City",
    "Shipping_Province", "Shipping_State", "Shipping_Code", "Email", "Phone", "Phone_Number",
    "Contact_Number", "Contact_Person", "Employees", "Delivery_Permit", "Special_Permit",
    "BIR_Registration_COR", "Business_registration", "Business_Permit",
    "General_Information_Sheet", "Created_Time", "Modified_Time", "Modified_By",
]
# ---- Fixed values: accepted file formats ----
FILE_TYPES = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "png": "image/png", "webp": "image/webp",
    "tif": "image/tiff", "bmp": "image/bmp", "heic": "image/heic", "heif": "image/heif",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "doc": "application/msword", "xls": "application/vnd.ms-excel",
}
