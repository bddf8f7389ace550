"""Words that business names are made of, in English, French and Indian habits, with their usual variants."""

# Given names with their short and variant forms (a form may belong to several names).
GIVEN = {
    "abdul": ["abdool"], "abigail": ["abby", "abbie", "gail"], "abraham": ["abe", "ibrahim"], "adrian": ["adrien"], "agnes": ["aggie", "nessa"],
    "albert": ["al", "bert", "bertie"], "alexander": ["alex", "sandy", "alec", "xander", "sasha", "alexandre"], "alfred": ["alf", "alfie", "fred"], "alice": ["ali", "allie"],
    "amanda": ["mandy"], "andrew": ["andy", "drew", "andre", "andreas"], "angela": ["angie"], "anita": [], "anna": ["ann", "anne", "annie", "hannah"],
    "anthony": ["tony", "ant", "antoine", "antonio"], "arthur": ["art", "artie"], "barbara": ["barb", "babs", "barbie"], "bartholomew": ["bart"], "benjamin": ["ben", "benj", "benny", "benjy"],
    "bernard": ["bernie"], "bradley": ["brad"], "caroline": ["carol", "carrie", "lina"], "catherine": ["cathy", "cath"], "charles": ["charlie", "chas", "chuck", "carlos"],
    "charlotte": ["lottie", "lotte"], "christina": ["chris", "tina", "chrissie", "christine"], "christopher": ["chris", "kit", "topher"], "clifford": ["cliff"], "cynthia": ["cindy"],
    "daniel": ["dan", "danny", "danl"], "david": ["dave", "davy"], "deborah": ["deb", "debbie", "debra"], "dennis": ["denis", "denny"], "dominic": ["dom", "dominique"],
    "donald": ["don", "donny"], "dorothy": ["dot", "dolly", "dottie"], "douglas": ["doug"], "edmund": ["ed", "ned"], "edward": ["ed", "ned", "ted", "eddie", "edouard"],
    "edwin": ["ed", "eddie"], "eleanor": ["ellie", "nell", "nora", "leonor"], "elizabeth": ["liz", "beth", "betty", "eliza", "lizzie", "elisabeth"], "emily": ["em", "emmy"], "eric": ["erik", "rick"],
    "ernest": ["ernie"], "eugene": ["gene"], "evelyn": ["evie", "eve"], "florence": ["flo", "flossie"], "frances": ["fran", "frankie", "fanny", "francoise"],
    "francis": ["frank", "fran", "francois", "francisco"], "frederick": ["fred", "freddie", "fritz", "frederic"], "gabriel": ["gabe"], "geoffrey": ["geoff", "jeff"], "george": ["georgie", "georges", "jorge"],
    "gerald": ["gerry", "jerry", "gerard"], "gregory": ["greg"], "guillaume": ["guill", "guy"], "harold": ["hal", "harry"], "helen": ["nell", "nellie", "helene", "elena"],
    "henry": ["hank", "harry", "henri"], "herbert": ["herb", "bert"], "hubert": ["hugh", "bert"], "ignatius": ["iggy", "nacho"], "isabella": ["bella", "izzy", "isabel", "isabelle"],
    "jacob": ["jake", "jacques"], "jacqueline": ["jackie"], "james": ["jim", "jimmy", "jas", "jamie"], "janet": ["jan"], "jennifer": ["jen", "jenny"],
    "jeremy": ["jerry", "jem"], "jessica": ["jess", "jessie"], "john": ["jack", "johnny", "jno", "jean", "juan"], "jonathan": ["jon", "jonny", "nathan"], "joseph": ["joe", "joey", "jos", "jose"],
    "josephine": ["jo", "josie"], "joshua": ["josh"], "judith": ["judy"], "julian": ["jules", "julien"], "katherine": ["kate", "kathy", "kat", "katie", "kathryn"],
    "kenneth": ["ken", "kenny"], "krishnan": ["krishna", "kris"], "lakshmi": ["lakshmy", "laxmi"], "lawrence": ["larry", "laurie", "laurence", "laurent"], "leonard": ["leo", "len", "lenny"],
    "lewis": ["lew", "louis", "lou", "luis"], "lillian": ["lily", "lil"], "louise": ["lou", "lulu"], "lucy": ["lucie", "lucia"], "margaret": ["maggie", "meg", "peggy", "marge", "marguerite"],
    "martha": ["marty", "mattie"], "martin": ["marty"], "mary": ["maria", "marie", "molly", "polly"], "matthew": ["matt", "mat", "mathieu"], "maximilian": ["max"],
    "michael": ["mike", "mick", "mickey", "michel", "miguel"], "mildred": ["millie"], "mohammed": ["mohd", "md", "mohammad", "muhammad", "mohamed"], "nancy": ["nan"], "natalie": ["nat", "natalia"],
    "nathaniel": ["nate", "nat", "nathan"], "nicholas": ["nick", "nico", "nicky", "nicolas"], "oliver": ["ollie", "olivier"], "pamela": ["pam"], "patricia": ["pat", "trish", "patty"],
    "patrick": ["pat", "paddy"], "paul": ["pablo", "paulo"], "peter": ["pete", "pierre", "pedro"], "philip": ["phil", "phillip", "philippe"], "priscilla": ["cilla"],
    "rajendra": ["raj", "rajender"], "ramesh": ["ram"], "raymond": ["ray"], "rebecca": ["becky", "becca"], "reginald": ["reg", "reggie"],
    "richard": ["rick", "dick", "rich", "ricardo"], "robert": ["rob", "bob", "bobby", "bert", "roberto"], "roger": ["rodge"], "ronald": ["ron", "ronnie"], "russell": ["russ"],
    "samantha": ["sam"], "samuel": ["sam", "sammy"], "sandra": ["sandy"], "sarah": ["sara", "sally", "sadie"], "sebastian": ["seb", "sebastien"],
    "srinivasan": ["srini", "sreenivasan", "srinivas"], "stephen": ["steve", "stevie", "steven", "etienne"], "subramanian": ["subbu", "subramaniam"], "susannah": ["sue", "susie", "suzie", "susan", "suzanne"], "sylvester": ["sly"],
    "terence": ["terry"], "theodore": ["ted", "theo", "teddy"], "theresa": ["terry", "tess", "teresa", "therese"], "thomas": ["tom", "thos", "tommy"], "timothy": ["tim"],
    "valentine": ["val"], "venkatesh": ["venky", "venkat"], "veronica": ["ronnie", "vera"], "victor": ["vic"], "victoria": ["vicky", "tori", "vic"],
    "vincent": ["vince", "vinny"], "virginia": ["ginny", "ginger"], "walter": ["walt", "wally"], "wilfred": ["wilf"], "william": ["wm", "bill", "will", "billy", "willy"],
    "winifred": ["winnie"], "zachary": ["zach", "zack"],
}

# Legal forms.
LEGAL = {
    "aktiengesellschaft": ["ag"], "company": ["co"], "corporation": ["corp"], "eurl": [], "gesellschaft": ["gmbh"], "incorporated": ["inc"], "limited": ["ltd"], "llc": [],
    "llp": [], "lp": [], "ltda": [], "nv": [], "oy": [], "plc": [], "pllc": [], "private": ["pvt", "pte"], "proprietary": ["pty"], "sa": [], "sarl": [], "sas": [],
    "sci": [], "scop": [], "snc": [], "spa": [], "srl": [],
}

# What a business does; phrases are written with a space.
TRADE = {
    "academy": ["acad", "academie"], "accountants": ["accountant", "accounting", "accts", "accounts", "acctg"], "advertising": ["advtg", "advert"], "agencies": ["agency", "agy"],
    "architects": ["architect", "architecture", "archts"], "assurances": ["assurance"], "auto parts": ["automotive parts"], "auto repair": ["auto rpr", "automotive repair", "automotive rpr", "auto repairs"],
    "bakery": ["bakeries", "bkry", "bakers", "baker"], "bank": ["banking", "bnk"], "bar": ["pub", "tavern"], "beauty salon": ["salon", "beauty parlour", "beauty parlor"],
    "boucherie": ["bouch"], "boulangerie": ["boul", "boulang"], "brothers": ["bros"], "building supplies": ["building supply", "bldg supplies", "bldg supply"],
    "cafe": ["coffee", "coffee house", "coffee shop"], "carpentry": ["carpenter", "carpenters"], "catering": ["caterers", "caterer"], "chemicals": ["chemical", "chem"],
    "cleaning": ["cleaners", "cleaner", "clng"], "clinic": ["clinics", "clnc", "clinique"], "clothing": ["apparel", "garments", "garment"], "communications": ["communication", "comms", "commns"],
    "compagnie": ["cie"], "computers": ["computer", "computing"], "constructions": ["construction", "const", "constr", "constrn"], "consulting": ["consultants", "consultancy", "consultant"],
    "consulting group": ["consulting grp", "cons group", "cons grp"], "couverture": ["couvreur"], "dairy": ["dairies"], "dental associates": ["dental assoc", "dental assocs"],
    "dental clinic": ["dental", "dentist", "dentists", "dentistry"], "design": ["designs", "designers"], "developers": ["developer", "development", "devt"], "distributors": ["distributor", "distribution", "distrs"],
    "electricals": ["electrical", "elec", "elecs", "electric", "electricals stores"], "electricite": ["electricien"], "electronics": ["electronic", "electrs"], "engineering": ["engineers", "engineer", "engg", "engrg", "engr"],
    "enterprises": ["enterprise", "entp", "ent", "entps"], "entertainment": ["entmt"], "etablissements": ["ets", "etablissement"], "exports": ["export", "exporters", "exporter"],
    "farm": ["farms", "farmers"], "finance": ["financial", "fin", "finances"], "florist": ["florists", "flowers", "fleuriste"], "foods": ["food", "food products"],
    "foundation": ["fdn", "fndn"], "furniture": ["furn", "furnishings", "furnishing"], "garage": ["gge", "garages"], "gallery": ["galleries", "galerie"],
    "grocery": ["groceries", "grocers", "epicerie"], "gymnasium": ["gym", "fitness"], "hardware": ["hdwe", "hardwares", "hrdwr"], "holdings": ["holding", "hldgs"],
    "hospital": ["hosp", "hospitals"], "hotel": ["hotels", "htl", "inn"], "imports": ["import", "importers"], "industries": ["inds", "industry", "indus", "industrie"],
    "insurance": ["ins", "insurers"], "international": ["intl", "int l", "int"], "investments": ["investment", "invt", "invs"], "jewellers": ["jewelers", "jwlrs", "jewellery", "jewelry"],
    "laboratories": ["laboratory", "labs", "lab", "laboratoire"], "landscaping": ["landscape", "lndscpg", "landscapers"], "laundry": ["launderers", "laundromat"], "law offices": ["law office", "attorneys", "lawyers", "advocates", "solicitors"],
    "library": ["librairie", "bookshop", "books"], "logistics": ["logistic", "lgstcs"], "maconnerie": ["macon"], "management": ["mgmt", "mgt"],
    "manufacturing": ["mfg", "manufacturers", "mfrs", "mfr"], "marketing": ["mktg", "mkting"], "media": [], "medical centre": ["medical center", "med center", "med ctr", "medical ctr"],
    "medical stores": ["medicals", "med stores", "medical store"], "menuiserie": ["menuis", "menuisier"], "metals": ["metal"], "mills": ["mill"],
    "motors": ["motor", "mtrs"], "nursery": ["nurseries"], "opticians": ["optical", "opticals", "optician", "optique"], "packaging": ["packagers", "pkg"],
    "painting": ["painters", "peinture"], "partners": ["partner", "ptnrs"], "patisserie": ["patiss"], "pharmaceuticals": ["pharma", "pharmaceutical"],
    "pharmacie": ["pharm", "phcie"], "pharmacy": ["phcy", "chemist", "chemists", "druggist", "druggists"], "photography": ["photo", "photographers", "studio"], "plastics": ["plastic"],
    "plomberie": ["plombier"], "plumbing services": ["plumbing svcs", "plbg svcs", "plbg services", "plumbing", "plumbers", "plbg"], "printers": ["printing", "press", "imprimerie", "prtg"], "productions": ["production", "prodns"],
    "products": ["product", "prods"], "properties": ["property", "props"], "property management": ["prop mgt", "prop mgmt", "property mgmt", "property mgt", "prop management"], "publishing": ["publishers", "publications", "pubs"],
    "real estate": ["realty", "realtors", "immobilier"], "recycling": [], "restaurant": ["rest", "restaurants", "bistro", "diner"], "roofing": ["roofers"],
    "salon de coiffure": ["coiffure", "coiffeur"], "school": ["schools", "sch", "ecole"], "security": ["sec", "securite"], "services": ["service", "svcs", "svc"],
    "societe": ["ste"], "software": ["sw"], "solutions": ["solution", "solns"], "stationers": ["stationery", "papeterie"],
    "steel": ["steels"], "stores": ["store", "shop", "shoppe"], "supermarket": ["super market", "supermarche", "mart"], "suppliers": ["supplies", "supply", "supplier"],
    "sweets": ["sweet house", "sweet", "confectionery", "confectioners", "confiserie"], "systems": ["system", "sys"], "tailors": ["tailor", "tailoring"], "technology": ["tech", "technologies", "techs"],
    "telecom": ["telecommunications", "telecoms"], "textiles": ["textile", "tex"], "tours and travels": ["travels", "travel", "tours"], "toys": ["toy"],
    "traders": ["trading", "trdrs", "trader", "trdg"], "transports": ["transp", "tpts", "transport", "tpt", "transportation"], "trust": ["trusts"], "upholstery": ["upholsterers"],
    "veterinary clinic": ["vet clinic", "vet clnc", "veterinary clnc", "veterinarian", "veterinary"], "watches": ["watch house", "horlogerie"], "wholesale": ["wholesalers", "wsl"], "works": ["workshop", "wks", "atelier"],
}

# Words that carry no identity.
EMPTY_WORDS = ["and", "n", "et", "the", "m", "s", "ms", "messrs", "of", "un", "und", "y"]
# Last words of town names of two words.
TOWN_ENDS = ["heights", "falls", "springs", "beach", "city", "grove", "hills", "junction", "park", "valley", "village"]
