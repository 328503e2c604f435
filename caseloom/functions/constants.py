"""Fixed values. They must stay as they are for results to be comparable."""

OTHER = "OTHER / UNKNOWN"

# --- fixed values: resolution words in a customer's later messages -------------------
RESOLUTION_PATTERNS = [
    r"\bthank(s|\s+you)?\b",
    r"\bfixed\b",
    r"\bsolved\b",
    r"\bworked\b",
    r"\bgreat\b",
    r"\bawesome\b",
    r"\bperfect\b",
    r"\bhelpful\b",
    r"\bappreciate\b",
]

# --- fixed values: taxonomy of the labeller, in tie-breaking order --------------------
INTENT_PATTERNS = {
    "SOFTWARE_UPDATE_ISSUES": [
        r"\bupdate\b", r"\bios\b", r"\bupdate(d|s)?\b", r"\bversion\b", r"\binstall\b",
        r"\bupgrade\b", r"\bsoftware\b",
    ],
    "BATTERY_POWER_CHARGING": [
        r"\bbattery\b", r"\bcharg(e|ing)\b", r"\bpower\b", r"\bdrain(ing)?\b", r"\bdied\b",
        r"\bpercent\b", r"\bplug\b",
    ],
    "ACCOUNT_LOGIN_SECURITY": [
        r"\baccount\b", r"\blogin\b", r"\bpasswords?\b", r"\block(ed)?\b", r"\bsign in\b",
        r"\bapple id\b", r"\bverify\b", r"\bverification\b", r"\bsecurity\b",
    ],
    "APP_CRASH_PERFORMANCE": [
        r"\bapp(s)?\b", r"\bcrash(es|ing)?\b", r"\bfreez(e|ing)\b", r"\bslow\b",
        r"\blag(gy)?\b", r"\bopen\b", r"\bwork(ing)?\b",
    ],
    "BILLING_REFUND_SUBSCRIPTION": [
        r"\bbill(ing)?\b", r"\brefund\b", r"\bcharg(ed|es)\b", r"\bmoney\b", r"\bpay(ment)?\b",
        r"\bsubscription\b", r"\bcard\b", r"\bpurchase\b", r"\bitunes\b",
    ],
    "ORDER_SHIPPING_DELIVERY": [
        r"\border\b", r"\bship(ping|ped)?\b", r"\bdeliver(y|ed)?\b", r"\btrack(ing)?\b",
        r"\bpack(age)?\b", r"\barriv(e|ed)\b", r"\bcourier\b",
    ],
    "CONNECTIVITY_NETWORK_WIFI": [
        r"\bwifi\b", r"\bbluetooth\b", r"\bconnect(ion)?\b", r"\bsignal\b", r"\bnetwork\b",
        r"\bcellular\b", r"\bdata\b", r"\bsim\b", r"\bpair(ing)?\b",
    ],
    "AUDIO_SPEAKER_MICROPHONE": [
        r"\baudio\b", r"\bsound\b", r"\bspeaker\b", r"\bmic\b", r"\bmicrophone\b",
        r"\bvolume\b", r"\bheadphone\b", r"\bairpods?\b",
    ],
    "DISPLAY_SCREEN_PHYSICAL": [
        r"\bscreen\b", r"\bdisplay\b", r"\bflicker(ing)?\b", r"\bblack\b", r"\btouch\b",
        r"\bcrack(ed)?\b", r"\bglass\b",
    ],
    "STORE_REPAIR_SERVICE": [
        r"\bstore\b", r"\bappointment\b", r"\brepair\b", r"\bgenius\b", r"\bservice\b",
        r"\breplace(ment)?\b", r"\bwarranty\b",
    ],
}

# --- fixed values: description, inclusion and exclusion text of each intent -----------
INTENT_TEXTS = {
    "SOFTWARE_UPDATE_ISSUES": (
        "Inquiries regarding software updates, OS upgrade bugs, installation failures, or issues occurring immediately after updating.",
        "Mentions software updates, OS version, update installation, or issues starting right after an update.",
        "Hardware physical damage, simple app store billing issues, or shipping queries.",
    ),
    "BATTERY_POWER_CHARGING": (
        "Issues related to battery life, rapid battery draining, device turning off, or failing to charge.",
        "Contains terms like battery, charging, power, battery drain, charger, cable.",
        "General software app crashes unless battery is explicitly cited.",
    ),
    "ACCOUNT_LOGIN_SECURITY": (
        "Questions regarding account access, locked accounts, password reset, 2FA, or login authentication.",
        "Mentions login, password, locked account, credentials, or account verification.",
        "Billing disputes without account access issues.",
    ),
    "APP_CRASH_PERFORMANCE": (
        "Reports of application crashes, system lag, frozen screen, or apps failing to launch.",
        "Mentions app freezing, crashing, unresponsive UI, or slow performance.",
        "Physical screen damage or internet network connectivity issues.",
    ),
    "BILLING_REFUND_SUBSCRIPTION": (
        "Billing inquiries, unauthorized charges, refund requests, payment processing issues, or subscription cancellations.",
        "Contains billing terms, payment, charge, refund, money, receipt, or subscription.",
        "Physical store hardware returns.",
    ),
    "ORDER_SHIPPING_DELIVERY": (
        "Questions about order status, shipment tracking, delayed delivery, or missing packages.",
        "Mentions order number, shipping, tracking, delivery status, or package delivery.",
        "Digital app store downloads.",
    ),
    "CONNECTIVITY_NETWORK_WIFI": (
        "Issues connecting to Wi-Fi, Bluetooth devices, cellular network data, or SIM card errors.",
        "Mentions Wi-Fi, Bluetooth, network connection, SIM, cellular data, or pairing.",
        "Power/battery issues.",
    ),
    "AUDIO_SPEAKER_MICROPHONE": (
        "Problems with sound output, low volume, distorted speaker sound, microphone unresponsiveness, or headphone connectivity.",
        "Mentions sound, volume, speaker, mic, audio, or headphones/AirPods.",
        "Display screen issues.",
    ),
    "DISPLAY_SCREEN_PHYSICAL": (
        "Issues involving physical screen damage, display flickering, black screen, or unresponsive touch input.",
        "Contains terms like screen, display, flicker, black screen, touchscreen.",
        "Software update bugs with display working fine.",
    ),
    "STORE_REPAIR_SERVICE": (
        "Requests for retail store appointments, hardware repair status, warranty service, or device replacement.",
        "Mentions store appointment, repair, service center, warranty, or hardware replacement.",
        "Self-service software troubleshooting.",
    ),
    OTHER: (
        "Customer messages that do not confidently fit into any supported intent taxonomy category.",
        "Messages with low confidence, general greetings, ambiguous text, or off-topic queries.",
        "Messages clearly matching a defined domain intent.",
    ),
}

# --- fixed values: patterns of the rule classifier, in tie-breaking order -------------
RULE_CLASSIFIER_PATTERNS = {
    "SOFTWARE_UPDATE_ISSUES": [
        r"\bupdate\b", r"\bos\b", r"\bsoftware\b", r"\bupgrade\b", r"\bfirmware\b",
        r"\binstallation\b", r"\bios\b", r"\bversion\b", r"\binstalling\b",
    ],
    "BATTERY_POWER_CHARGING": [
        r"\bbattery\b", r"\bcharge\b", r"\bcharging\b", r"\bcharger\b", r"\bpower\b",
        r"\bdrain\b", r"\bdraining\b", r"\bplug\b", r"\bcable\b",
    ],
    "ACCOUNT_LOGIN_SECURITY": [
        r"\blogin\b", r"\bpassword\b", r"\blocked\b", r"\bsign in\b", r"\blog in\b",
        r"\bpasscode\b", r"\b2fa\b", r"\bcredentials\b", r"\bunlocked\b", r"\bauth\b",
    ],
    "APP_CRASH_PERFORMANCE": [
        r"\bcrash\b", r"\bcrashes\b", r"\bcrashing\b", r"\bfreeze\b", r"\bfrozen\b",
        r"\bfreezing\b", r"\blag\b", r"\blagging\b", r"\bunresponsive\b", r"\bglitch\b",
    ],
    "BILLING_REFUND_SUBSCRIPTION": [
        r"\brefund\b", r"\bbill\b", r"\bbilling\b", r"\bcharge\b", r"\bcharged\b",
        r"\bpayment\b", r"\bsubscription\b", r"\bcancel\b", r"\bmembership\b", r"\breceipt\b",
    ],
    "ORDER_SHIPPING_DELIVERY": [
        r"\border\b", r"\bpackage\b", r"\bdelivery\b", r"\bshipment\b", r"\bshipping\b",
        r"\btrack\b", r"\btracking\b", r"\bdelivered\b", r"\bcourier\b", r"\bparcel\b",
        r"\barrive\b",
    ],
    "CONNECTIVITY_NETWORK_WIFI": [
        r"\bwifi\b", r"\bwi-fi\b", r"\bbluetooth\b", r"\bnetwork\b", r"\bsignal\b",
        r"\bcellular\b", r"\bsim\b", r"\boffline\b", r"\bpairing\b", r"\bconnect\b",
    ],
    "AUDIO_SPEAKER_MICROPHONE": [
        r"\bsound\b", r"\bvolume\b", r"\bspeaker\b", r"\bmic\b", r"\bmicrophone\b",
        r"\baudio\b", r"\bheadphone\b", r"\bheadphones\b", r"\bairpods\b",
    ],
    "DISPLAY_SCREEN_PHYSICAL": [
        r"\bscreen\b", r"\bdisplay\b", r"\bflicker\b", r"\bflickering\b", r"\bblack screen\b",
        r"\btouchscreen\b", r"\bcracked\b",
    ],
    "STORE_REPAIR_SERVICE": [
        r"\brepair\b", r"\bappointment\b", r"\bwarranty\b", r"\breplace\b",
        r"\bservice center\b", r"\breplacement\b", r"\bstore\b",
    ],
}

# --- fixed values: escalation policy ---------------------------------------------------
UNAVAILABLE_ACTION_PATTERNS = [
    r"\brefund my money\b", r"\bgive me a refund\b", r"\bcancel my order now\b",
    r"\bchange my address\b", r"\bdelete my account\b", r"\breset my password\b",
    r"\bclose my account\b", r"\bsue\b", r"\blegal action\b", r"\blawyer\b",
    r"\bhacked\b", r"\bstolen card\b", r"\bfraud\b", r"\bunauthorized charge\b",
]
AMBIGUOUS_PATTERNS = [r"^\s*help\s*$", r"^\s*@\w+\s*$", r"^\s*why\s*$", r"^\s*wtf\s*$", r"^\s*\?\s*$"]
MIN_INTENT_CONFIDENCE = 0.45
MIN_SIMILARITY = 0.40
MIN_CLEAR_LENGTH = 5

REASON_ACTION = "Request requires an action unavailable to the AI."
REASON_AMBIGUOUS = "Customer request is ambiguous."
REASON_TAXONOMY = "The issue is outside the supported intent taxonomy."
REASON_CONFIDENCE = "Intent confidence below validated threshold (%.4f < %.2f)."
REASON_NO_CASES = "No historical resolution examples found."
REASON_SIMILARITY = "No sufficiently similar historical resolution (Similarity %.4f < %.2f)."
REASON_CONFLICT = "Historical examples provide conflicting guidance."
REASON_FROM_REPLY = "LLM determined escalation required."

# --- fixed values: reply drafting -------------------------------------------------------
APOLOGY_REPLY = (
    "I'm sorry for any trouble! We'd like to look into this for you. "
    "Please connect with our support team so we can assist. ^CS"
)

# --- fixed values: reply rubric ----------------------------------------------------------
UNSUPPORTED_CLAIM_PATTERNS = [
    r"\bI have (issued|processed|refunded|cancelled|updated|sent|confirmed)\b",
    r"\byour refund (has been|will be) (issued|processed|sent|credited)\b",
    r"\bI (can|will) (give|send|issue|process|arrange)\b.*\brefund\b",
    r"\byour order (has been|will be) (cancelled|updated)\b",
    r"\bI have updated your (address|account|password)\b",
    r"\bguaranteed (delivery|refund|replacement)\b",
    r"\bwithin (24|48|72) hours? (you will|you'll) receive\b",
    r"\bI have escalated\b",
    r"\byou will receive (a refund|your (order|package)) by\b",
]
REPLY_KEYWORDS = {
    "ORDER_SHIPPING_DELIVERY": ["order", "package", "delivery", "shipping", "tracking"],
    "BILLING_REFUND_SUBSCRIPTION": ["charge", "refund", "payment", "bill", "subscription"],
    "ACCOUNT_LOGIN_SECURITY": ["account", "login", "password", "locked", "access"],
    "APP_CRASH_PERFORMANCE": ["app", "crash", "slow", "freeze", "performance"],
    "BATTERY_POWER_CHARGING": ["battery", "charge", "charger", "power"],
    "SOFTWARE_UPDATE_ISSUES": ["update", "software", "version", "upgrade"],
    "CONNECTIVITY_NETWORK_WIFI": ["wifi", "network", "connection", "bluetooth"],
    "AUDIO_SPEAKER_MICROPHONE": ["sound", "speaker", "audio", "volume", "mic"],
    "DISPLAY_SCREEN_PHYSICAL": ["screen", "display", "cracked", "flicker"],
    "STORE_REPAIR_SERVICE": ["repair", "warranty", "store", "replace", "service"],
}
POSITIVE_MARKERS = [
    "sorry", "apolog", "understand", "help", "look into", "assist",
    "thank", "please", "happy", "team", "investigate", "support",
]
AGGRESSIVE_MARKERS = ["stupid", "idiot", "shut up", "not my problem", "impossible"]
GROUNDEDNESS_CUTS = [(0.5, 5), (0.35, 4), (0.20, 3), (0.08, 2)]
RELEVANCE_CUTS = [(0.4, 5), (0.28, 4), (0.16, 3), (0.06, 2)]

# --- fixed values: brand ranking, splits, grids, targets -----------------------------------
BRAND_WEIGHTS = {"volume": 0.40, "multi_turn": 0.30, "vocabulary": 0.20, "resolution": 0.10}
MIN_BRAND_CONVERSATIONS = 50
SPLIT_RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
SPLIT_SEED = 42
POLICY_GRID = (
    [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60],
    [0.25, 0.35, 0.40, 0.45, 0.50],
)
METRIC_TARGETS = [
    ("macro_f1", ">=", 0.85),
    ("recall_at_5", ">=", 0.85),
    ("mrr", ">=", 0.70),
    ("selective_accuracy", ">=", 0.95),
    ("unsupported_claim_rate", "<=", 0.05),
    ("groundedness", ">=", 4.0),
]
# Timestamp text such as "Tue Oct 31 22:10:47 +0000 2017", read without its weekday.
CREATED_AT_FORMAT = "MMM dd HH:mm:ss Z yyyy"
