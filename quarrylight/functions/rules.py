"""Rule tables of the scorer. They must equal the vocabulary that users' reports are scored with today."""

from __future__ import annotations

# Span roles and their patterns.
SPAN_PATTERNS = {
    "energy_cue": r"\b(\d+(?:[.,]\d+)?\s?(?:m|meter|metre|ft|feet|kg|ton|kv|volt|bar|psi|deg ?c)\b|monkey ?board|derrick|suspended load|live (?:panel|equipment|line)|H2S|rotating|pressuris\w+|excavat\w+|confined space)",
    "release_cue": r"\b(gir(?:a|i|e)\w*|fell|fall(?:en|ing)?|dropp?ed|slipp?ed|struck|hit|released|leak(?:ed|age)?|burst|ruptur\w+|caught fire|toot\w+|contacted)\b",
    "no_exposure_cue": r"\b(koi bhi\s+\w+\s+(?:nahi|nai)\s+(?:gaya|gaye|gayi|tha)|na hi koi (?:exposure|chot|injury)|(?:no ?body|no one|nobody) (?:was |were )?(?:exposed|present|inside|entered)|koi (?:andar )?nahi (?:gaya|tha)|area (?:was )?(?:clear|vacant|empty))",
    "no_release_cue": r"\b(no (?:fall|drop|release|contact|spill)|nahi gir\w*|did not (?:fall|drop)|abhi tak nahi|about to|almost|nearly|prevented)\b",
    "exposure_cue": r"\b(neeche|niche|below|underneath|under the|line of fire|standing near|paas (?:khada|khade)|inside (?:the )?(?:tank|vessel)|in the way|\d+\s?(?:log|people|persons?|workers?) (?:the|were|standing))",
    "control_present": r"\b(harness (?:worn|clipped|anchored)|barricad\w+ (?:was |were )?(?:done|in place|erected)|LOTO (?:done|verified|applied)|permit (?:taken|issued|valid)|gas test (?:done|completed)|SCBA (?:worn|used)|guard (?:in place|fitted)|exclusion zone (?:set|established)|lanyard (?:anchored|clipped)|(?:harness|barricading|barricade|permit|PTW|LOTO|gas ?test|guard|SCBA|lifeline|lanyard|shoring|isolation)\s+(?:sahi\s+)?(?:laga\w*|pehn\w*|li?y[ae]|kiy[ae]|hua|hui|tha|thi|thee)\b|\bsahi\s+(?:tarike se\s+)?(?:barricading|isolation|harness)\b)",
    "control_absent": r"(?:\bno\s+(?:\w+\s+){0,2}(?:harness|barricad\w+|permit|PTW|LOTO|lockout|gas ?test\w*|guard|SCBA|BA set|exclusion zone|banksman|spotter|shoring|lifeline|lanyard|isolation|tag|supervision|training|test)|\bwithout\s+(?:\w+\s+){0,2}(?:harness|permit|PTW|LOTO|barricad\w+|guard|SCBA|gas ?test\w*|isolation|lifeline|lanyard|approval|authoris\w+|authoriz\w+)|\bbina\s+(?:\w+\s+){0,2}(?:kiye|kiya|ke)?|\b(?:harness|barricading|barricade|permi(?:t|ssion)|PTW|LOTO|gas ?test\w*|guard|SCBA|shoring|isolation|lifeline|lanyard|training|test|authori[sz]ation|clearance)\s+(?:nahi|nai|nahin)\b|\bnahi\s+(?:tha|thi|kiya|liya|hua)\b|\bnot\s+(?:isolated|barricaded|guarded|tested|tagged|anchored|clipped|authorised|authorized|permitted|supervised)\b)",
    "control_ineffective": r"\b(worn but not clipped|not anchored|not verified|expired|overdue|defective|damaged|bypassed|disabled|partially|loose|not tightened|discharged|empty)\b",
    "pseudo_control": r"\b(hard ?hat|helmet|safety shoes|training (?:given|provided)|signage|sign board|experienced (?:worker|operator)|cone (?:placed|kept)|toolbox talk|briefing (?:given|done)|careful)\b",
    "negation_cue": r"\b(no|not|nahi|nahin|nai|bina|without|never|koi nahi)\b",
    "outcome_cue": r"\b(no injury|koi (?:chot|injury) nahi|injur\w+|fracture|amputat\w+|hospitalis\w+|hospitaliz\w+|fatal\w*|died|death|burn\w*|first aid|medevac\w*|unconscious|LTI|near ?miss)\b",
    "statement_cue": r"\b(if|agar|could have|would have|last (?:month|week|year)|pichle|during (?:training|drill|mock)|has been rectified|action closed)\b",
}

# Statement types in the order in which they are tried.
STATEMENT_TYPES = {
    "training_example": r"\b(training|drill|mock|toolbox talk|TBT|demonstration|exercise|induction|case (?:study|ka study)|awareness session|discuss kiya gaya)\b",
    "hypothetical": r"\b(if|agar|could have|would have|might have|ho sakta|sakta tha|suppose|imagine|what if)\b",
    "historical": r"\b(last (month|week|year)|pichle|purane|puran[ai]|do saal|\d+ saal purane|previously|earlier incident|in 20\d\d|history|past incident)\b",
    "corrective_completed": r"\b(has been (rectified|corrected|closed)|rectified|action closed|theek kar diya|thik kar diya|resolved|完成)\b",
    "observed": r"\b(worker|employee|operator|technician|rigger|roustabout|crew|person|log|aadmi|admi|banda|he|she|they|was|were|is|are)\b",
}

# Hazards with cues, energy type, barrier, consequence, cluster and rules.
HAZARDS = {
    "dropped_object": (r"\b(gir(a|i|e)|dropp?ed|fell|falling|neeche gir|upar se|monkey board|derrick|tool ?box|spanner|hammer|pipe|casing|elevator|block)\b", "gravity", "exclusion_zone_barricading", "fatal_head_injury", "DROPPED_OBJECT_NO_EXCLUSION_ZONE", ["line_of_fire", "work_at_height"]),
    "fall_from_height": (r"\b(harness|lanyard|fall arrest|scaffold|ladder|platform|height|uncha|chhat|roof|edge|opening|floor opening)\b", "gravity", "fall_protection", "fatal_fall", "WORK_AT_HEIGHT_NO_FALL_ARREST", ["work_at_height"]),
    "electrical_contact": (r"\b(live|kV|volt|电|panel|panl|switchgear|LOTO|lock ?out|isolation|energis\w*|energiz\w*|bijli|current|earthing|breaker)\b", "electrical", "energy_isolation", "electrocution", "LIVE_WORK_NO_ISOLATION", ["energy_isolation"]),
    "confined_space": (r"\b(confined space|vessel entry|tank entry|manhole|H2S|oxygen|O2|gas test|SCBA|BA set|purge|nitrogen)\b", "chemical", "gas_test_and_permit", "asphyxiation", "CONFINED_SPACE_NO_GAS_TEST", ["confined_space"]),
    "hot_work": (r"\b(welding|grinding|cutting torch|hot work|spark|flame|naked light|gas cutting)\b", "thermal", "hot_work_permit", "fire_or_burns", "HOT_WORK_NO_PERMIT", ["hot_work"]),
    "pressure_release": (r"\b(pressure|psi|bar|kg/cm2|hydro ?test|blow ?out|kick|choke|relief valve|pressuris|pressuriz|line break)\b", "pressure", "depressurisation_and_isolation", "impact_or_fluid_injection", "PRESSURISED_LINE_NOT_ISOLATED", ["line_of_fire", "energy_isolation"]),
    "mechanical_entanglement": (r"\b(rotating|drum|belt|pulley|auger|tong|spinner|guard|nip point|shaft|draw ?works|pump jack)\b", "mechanical", "machine_guarding", "amputation_or_crush", "ROTATING_EQUIPMENT_NO_GUARD", ["safe_mechanical_lifting"]),
    "vehicle_or_mobile_plant": (r"\b(vehicle|truck|trailer|forklift|crane|excavator|reversing|banksman|gaadi|dumper|loader|convoy|overspeed\w*|speeding|seat ?belt|collision|overtak\w*|skid\w*|tyre burst|brake fail\w*)\b", "motion", "traffic_management", "struck_by_vehicle", "MOBILE_PLANT_NO_SEGREGATION", ["driving", "line_of_fire"]),
    "lifting_operation": (r"\b(sling|shackle|hook|lifting|suspended load|load ke neeche|rigging|crane lift|winch|hoist)\b", "gravity", "lift_plan_and_exclusion_zone", "struck_by_falling_load", "SUSPENDED_LOAD_PERSON_UNDERNEATH", ["safe_mechanical_lifting", "line_of_fire"]),
    "excavation": (r"\b(excavat|trench|shoring|pit|digging|khudai|bench(ing)?)\b", "gravity", "shoring_and_benching", "burial_or_crush", "EXCAVATION_NO_SHORING", ["excavation"]),
}

# Defaults where a text states no mass (kg) or height (m), in order.
DEFAULT_MASS = [("tool ?box", 4.5), ("spanner|wrench", 1.2), ("hammer", 1.5), ("drill (pipe|collar)", 95.0), ("casing", 120.0), ("elevator", 180.0), ("scaffold (pipe|tube)|scaffolding", 12.0), ("grating", 25.0), ("drum|barrel", 200.0), ("cargo net", 750.0)]
DEFAULT_HEIGHT = [("monkey ?board", 20.2), ("derrick|mast", 30.0), ("rig floor", 6.0), ("scaffold", 4.0), ("platform", 3.0), ("ladder", 3.0), ("roof|chhat", 5.0), ("first (floor|storey)", 3.5)]
# Thresholds of volts, bar, degrees and joules, gravity, and the mass and height bands that can kill.
VOLTS, BAR, CELSIUS, JOULES, GRAVITY = 50.0, 7.0, 65.0, 680.0, 9.81
FATAL_BANDS = [(10.0, 2.0), (5.0, 3.0), (2.0, 6.0), (1.0, 10.0), (0.5, 15.0), (0.1, 25.0)]
LIGHT_FATAL_HEIGHT = 30.0
# Fixed value: metres from which the fall of a person is high energy.
PERSON_FALL = 1.2

# Phrases that the four questions look for.
SERIOUS = r"\b(fatal\w*|died|death|killed|amputat\w+|fractur\w+|hospitalis\w+|hospitaliz\w+|surgery|concussion|unconscious|coma|paralys\w+|LTI|lost time|maut|mar gaya|haddi (?:toot|tut)\w*|2nd degree|3rd degree|second degree|third degree)\b"
NO_INJURY = r"\b(no injury|no injuries|koi (?:chot|injury) nahi|nobody (?:was )?(?:hurt|injured)|uninjured|without injury|bach gay[ae]|near ?miss)\b"
FINGER = r"\b(finger|toe|ungli)\b"
DEGRADED = r"\b(khula|khuli|tuta|tuti|toota|tooti|blocked|block|jam|jammed|damaged|broken|defective|faulty|expired|overdue|missing|removed|bypass\w*|disabled|inhibited|not (?:working|functioning|anchored|clipped|verified|secured|tested)|kaam nahi kar|band tha|band thi|loose|dheela|partially|incomplete|adhura)\b"
BEING_REMOVED = r"\b(khol\w*|hata\w*|nikal\w*|utar\w*|kaat\w*|open(?:ing|ed)?|remov\w*|dismantl\w*|loosen\w*|slack\w*|break\w*|todd?\w*)\b"
LOW_ENERGY = r"\b(chota|chhota|minor|small|slight|superficial|first aid (?:only|diya|given)|cardboard|carton|paper cut|hand tool|screwdriver|scratch|graze|bruise|knee height|waist height|ankle|stool|step ?stool|low level|ground level|12 ?v|24 ?v|battery|torch)\b"
MINIMISER = r"\b(sirf ek|chhoti si baat|choti si baat|bas itna|itni si baat|sab kuch theek|sab kuch perfect|koi badi baat nahi|minor si|just a|only a small)\b"
PERSON_ONLY = r"^\W*(?:the |ek |a |one |do |teen |\d+ )?(?:worker|workers|employee|operator|technician|rigger|roustabout|helper|crew|person|people|log|aadmi|admi|banda|bande|mazdoor|labour|labor|staff|supervisor|engineer|contractor|driver|he|she|they)s?\W*$"
OUTCOME_WORDS = r"\b(injur\w+|chot|damage|harm|casualt\w+|loss)\b"
CONTROL_WORDS = r"\b(harness|barricad\w*|permit|PTW|LOTO|guard|SCBA|gas test|shoring|banksman|exclusion zone)\b"
RELEASE_WORDS = r"\b(fall|fell|gir\w*|drop|release|contact|spill|leak)\b"

# Harms in both scripts, in the order in which they are tried.
HARMS = {
    "fatal": r"fatal[\wऀ-ॿ]*|died|death|killed|maut|mar gaya|mrityu|मृत्यु|मर गया|मौत",
    "amputation": r"amputat[\wऀ-ॿ]+|kat ?ke alag|ungli kat gayi|कट कर अलग",
    "fracture": r"fractur[\wऀ-ॿ]*|haddi (?:toot|tut)[\wऀ-ॿ]*|हड्डी टूट[\wऀ-ॿ]*|फ्रैक्चर",
    "break": r"toot gay[ai]|tut gay[ai]|टूट गय[ाी]",
    "unconscious": r"unconscious|behosh|senseless|collapsed|coma|बेहोश|बेहोशी",
    "asphyxia": r"saans (?:nahi|rukh|band)[\wऀ-ॿ]*|dum ghut[\wऀ-ॿ]*|ghutan|suffocat[\wऀ-ॿ]*|asphyx[\wऀ-ॿ]*|breath(?:ing)? (?:difficult|problem|trouble)|breathless|सांस (?:नहीं|रुक)[\wऀ-ॿ]*|दम घुट[\wऀ-ॿ]*",
    "electric_shock": r"electric shock|electrocut[\wऀ-ॿ]*|current laga|shock laga|jhatka laga|करंट लग[\wऀ-ॿ]*|बिजली का झटका|झटका लग[\wऀ-ॿ]*",
    "burn": r"burn(?:t|ed|s|ing)?\b|jal gay[ai]|jal gaya|jhulas[\wऀ-ॿ]*|scald[\wऀ-ॿ]*|जल गय[ाी]|जल गया|झुलस[\wऀ-ॿ]*",
    "chemical_irritation": r"jalan|irritation|itch[\wऀ-ॿ]*|khujli|watering|paani aa (?:raha|rahi)|redness|laal ho gay[ai]|dhundhla|blurred|dikh(?:na|ai) (?:band|nahi)|chubh[\wऀ-ॿ]* raha|जलन|खुजली|लाल हो गय[ाी]|धुंधला",
    "poisoning": r"ulti|vomit[\wऀ-ॿ]*|nausea|chakkar|dizzy|dizziness|giddy|उल्टी|चक्कर|बेचैनी",
    "crush": r"crush[\wऀ-ॿ]*|kuchal[\wऀ-ॿ]*|dab gay[ai]|pinch[\wऀ-ॿ]*|fas gay[ai]|phas gay[ai]|कुचल[\wऀ-ॿ]*|दब गय[ाी]|फंस गय[ाी]",
    "cut": r"\bcut\b|kat gay[ai]|kat gaya|katne|laceration|bleeding|khoon (?:beh|nikal)[\wऀ-ॿ]*|deep wound|gash|कट गय[ाी]|खून (?:बह|निकल)[\wऀ-ॿ]*|घाव",
    "bruise": r"bruise[\wऀ-ॿ]*|neel pad|contusion|swelling|sujan|soojan|sprain|moch|mooch|splinter|chubh gay[ai]|chubha|kaanta|scratch[\wऀ-ॿ]*|kharonch|rash|नील|सूजन|मोच|खरोंच",
    "generic": r"injur[\wऀ-ॿ]+|chot (?:lag|aa)[\wऀ-ॿ]*|chot lagi|hurt|ghayal|zakhmi|चोट|घायल|ज़ख्मी|जख्मी",
}
# Severity of harms, 3 (serious) to 0.
HARM_LEVELS = {"fatal": 3, "amputation": 3, "fracture": 3, "unconscious": 3, "asphyxia": 3, "electric_shock": 3, "burn": 3, "crush": 3, "chemical_irritation": 2, "poisoning": 2, "cut": 2, "bruise": 1, "generic": 1, "break": 0}
# Body parts in both scripts, in the order in which they are tried; critical parts raise a 2 to 3.
BODY_PARTS = {
    "eyes": r"aankh[\wऀ-ॿ]*|ankh[\wऀ-ॿ]*|eyes?|nazar|आंख[\wऀ-ॿ]*|आँख[\wऀ-ॿ]*",
    "head": r"\bsir\b|sar|head|skull|khopdi|forehead|matha|सिर|माथा",
    "face": r"face|chehra|chehre|mu(?:h|nh)|mouth|hoth|lips|चेहरा|मुंह|मुँह",
    "airway": r"lungs?|phephde|saans|breath[\wऀ-ॿ]*|gala|throat|chest|seena|seene|nose|naak|फेफड|सांस|गला|छाती|सीना|नाक",
    "spine": r"spine|reedh|peeth|back\b|kamar|neck|gardan|रीढ़|पीठ|कमर|गर्दन",
    "torso": r"pet|stomach|abdomen|kandha|shoulder|पेट|कंधा",
    "leg": r"pair|paon|paer|legs?|foot|feet|ghutna|knee|ankle|takhna|thigh|jangh|पैर|पांव|घुटन[\wऀ-ॿ]*|टखन[\wऀ-ॿ]*",
    "hand": r"haath|hath|hands?|arm|wrist|kalai|elbow|kohni|हाथ|कलाई|कोहनी",
    "finger": r"ungli[\wऀ-ॿ]*|fingers?|thumb|angutha|toes?|उंगल[\wऀ-ॿ]*|अंगूठ[\wऀ-ॿ]*",
    "skin": r"skin|chamdi|tvacha|body|badan|sharir|त्वचा|चमड़ी|शरीर|बदन",
}
CRITICAL_PARTS = ("eyes", "head", "face", "airway", "spine", "torso")
HARM_NEGATED_BEFORE = r"\b(?:no|koi|without|nahi|not|bina|कोई|नहीं)\s+(?:\w+\s+){0,2}$"
HARM_NEGATED_AFTER = r"^\s*(?:\w+\s+){0,1}(?:nahi|nai|nahin|not|नहीं)\b"
HARM_MINIMISED = r"\b(halka|halki|thoda|thodi|minor|slight\w*|superficial|first aid|chhota|chota|small|mamuli|hairline|thoda sa|जरा|थोड़ा|हल्का|हल्की|मामूली|eye ?wash|paani se dho\w*|wash(?:ed)? (?:with water|off|it)|rest (?:diya|given|le liya)|kaam pe wapas|resumed work|back to work)\b"

# Who acts; cues of unsafe acts and of unsafe conditions with their tags, in the order in which they are tried; what happens to a person.
ACTOR = r"\b(operator|worker|technician|attendant|driver|electrician|engineer|helper|staff|employee|crew|fitter|welder|rigger|foreman|supervisor|contractor|labour|labor|roustabout|derrickman|driller|mechanic|fitter|person|man|colleague|collique|mistri|khalasi|mazdoor|karmchari|aadmi|banda|log|karigar|JE|AE|I/C|in-?charge)\b"
ACTS = [
    (r"\b(nahi|na)\s+(pehn\w*|lagay\w*|laga\w*|pahn\w*)", "ppe_not_worn"),
    (r"\b(without|not)\s+(wearing|using|donning)\b", "ppe_not_worn"),
    (r"\b(did\s+not|didn'?t|failed\s+to)\s+(wear|use|don|follow|check|isolate|test)\b", "procedure_not_followed"),
    (r"\bpehn\w*\s+(bina|binaa)\b", "ppe_not_worn"),
    (r"\bbina\s+[\w\s]{0,24}?\s*(ke|kiye|liye)\b", "procedure_not_followed"),
    (r"\b(kiye|liye|banaye|lagaye)\s+bina\b", "procedure_not_followed"),
    (r"\bwithout\s+(a\s+)?(permit|ptw|loto|isolation|gas\s*test|jsa|authorisation|authorization|clearance|barricad\w*|supervision)\b", "procedure_not_followed"),
    (r"\b(bypass\w*|override\w*|overrode|disabl\w*|defeat\w*|tamper\w*)\b", "control_bypassed"),
    (r"\b(hata\s*(diya|di|dena)|nikal\s*(diya|di)|utar\s*(diya|di)|khol\s*(diya|di|na\s+shuru))\b", "control_bypassed"),
    (r"\b(climb\w*|jump\w*|reach\w*\s+into|lean\w*|stood\s+on|standing\s+on|crawl\w*|crossed?\s+over)\b", "risky_position"),
    (r"\b(chadh\s*(gaya|gayi|kar)|kood\w*|jhuk\s*kar|latak\w*)\b", "risky_position"),
    (r"\b(switched?\s+on|started|operated|ran)\b[^.]{0,40}\bwhile\b[^.]{0,40}\b(fixing|repair\w*|cleaning|adjust\w*|inside)\b", "operated_during_work"),
    (r"\b(manually|by\s+hand)\s+(push\w*|lift\w*|operat\w*|open\w*)\b", "manual_workaround"),
    (r"\b(push\w*|lift\w*|operat\w*|open\w*|mov\w*)\s+manually\b", "manual_workaround"),
    (r"\b(speed\w*|rash\w*|overload\w*|short\s*cut|shortcut)\b", "risky_behaviour"),
]
CONDITIONS = [
    (r"\b(slip+er\w*|phisal\w*|chikn\w*|greasy|wet\s+floor|gil[ae])\b", "slippery_surface"),
    (r"\b(slip+ed|slid|slipping|tripp?ed|trip+ing|stumbl\w*|phisal\s*gay\w*)\b", "slip_trip_surface"),
    (r"\b(spill\w*|leak\w*|seep\w*|overflow\w*|ris\w*\s+leak|tapak\w*)\b", "spill_or_leak"),
    (r"\b(broken|damaged|defective|faulty|crack\w*|tut[ae]|toot\w*|phat[ae]|fat\s+gay\w*|kharab|bigad\w*|collaps\w*|(rope|wire|sensor|brake|valve|switch|limit)\s+fail\w*|worn\s*out|corrod\w*|jang)\b", "damaged_equipment"),
    (r"\b(uncovered|open\s+(manhole|drain|pit|trench)|khul[ai]\s+(nali|manhole|pit)|bina\s+cover|cover\s+nahi|missing\s+(cover|guard|grating))\b", "opening_unprotected"),
    (r"\b(unguarded|no\s+guard|guard\s+(missing|removed)|exposed\s+(wire|cable|conductor|terminal|part)|naked\s+wire|tar\s+khul\w*)\b", "unguarded_hazard"),
    (r"\b(barricad\w*\s+(nahi|absent|missing|not)|no\s+barricad\w*|bina\s+barricad\w*|unbarricaded|cordon\w*\s+nahi)\b", "no_barricade"),
    (r"\b(poor|dim|insufficient|inadequate|low)\s+(light\w*|illuminat\w*|visibility)\b", "poor_lighting"),
    (r"\b(andher[aa]|roshni\s+(kam|nahi)|light\s+nahi)\b", "poor_lighting"),
    (r"\b(obstruct\w*|cluttered|blocked|block\s+ho|jam+ed|jam\s+(hai|tha)|kept\s+(near|along|on)|padd?[ae]\s+(the|tha|hue))\b", "obstruction"),
    (r"\b(loose|dheel[ae]|unbalanc\w*|unstable|uneven|wobbl\w*|hil\s+rah\w*|high\s+stack\w*|improperly\s+stack\w*)\b", "unstable_arrangement"),
    (r"\b(sharp\s+edge|protrud\w*|nikl[ae]\s+hu\w*|dangling|hanging|latk\w*)\b", "protrusion_or_dangling"),
    (r"\b(short[\s-]*circuit\w*|spark\w*|earthing\s+(nahi|missing)|no\s+earthing)\b", "electrical_defect"),
    (r"\b(kaam\s+nahi\s+kar|not\s+working|non[\s-]*functional|out\s+of\s+order|band\s+(pada|padi|hai|tha))\b", "equipment_not_working"),
    (r"\bnot\s+(rotating|turning|running|functioning|closing|latching|holding|locking|seated|secured)\b", "equipment_not_working"),
]
PASSIVE = r"\b(almost|nearly|about\s+to\s+be|narrowly)\s+(hit|struck|knock\w*|injur\w*|caught|pinch\w*|crush\w*|run\s+over)\b|\b(hit|struck|knock\w*|pinch\w*)\s+by\b"

# Descriptions of routine operations, which are no events.
ROUTINE = ["vehicle arrived at the gate", "parked in the designated area", "toolbox talk conducted", "routine patrol"]
