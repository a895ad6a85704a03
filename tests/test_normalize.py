import pytest

from ledgerlink.functions import normalize as n

NAMES = [
    ("Lloyd Trading Private Limited", {"name_core": "lloyd trading"}),
    ("LLOYD TRADING PVT LTD", {"name_core": "lloyd trading"}),
    ("Lloyd Trading Pvt. Ltd.", {"name_core": "lloyd trading", "name_legal": "ltd pvt"}),
    ("Metro Motors (L.L.C.)", {"name_core": "metro motors", "name_legal": "llc"}),
    ("Saint Cloud Youth Association P.C.", {"name_legal": "pc"}),
    ("Leslie K. Flagg, ([M.D.])", {"name_core": "leslie k flagg"}),
    ("Arckelo D.B.A. Metro Motors LLC", {"name_core": "metro motors", "name_alt": "arckelo"}),
    ("Ectoarc t/a Northern Mercantile Clinic", {"name_core": "northern mercantile clinic"}),
    ("Cirawex formerly known as Thane Agro Private Limited", {"name_core": "thane agro"}),
    ("Ectolumdrex dba X+ Madison Inc", {"name_core": "x madison"}),
    ("saintcloudyouth.com", {"name_core": "saintcloudyouth", "name_is_domain": True}),
    ("#centraleducation", {"name_is_domain": True}),
    ("SHIVSHAKTI VIDYALAYA OVERSEAS CORPORATION | www.shivshakti.com", {"name_core": "shivshakti vidyalaya overseas"}),
    ("-- Holloway Peak Inc Seafood", {"name_core": "holloway peak seafood"}),
    ("<< Team Ecole", {"name_core": "team ecole"}),
    ("Tónet", {"name_core": "tonet"}),
    ("Midwest  Fell0wship​ LLC", {"name_core": "midwest fellowship"}),
    ("Energy Dgshit 8uildcon Private Limited", {"name_core": "energy dgshit buildcon"}),
    ("Mahima & Sons Private Limited", {"name_norm": "mahima and sons pvt ltd"}),
    ("Thermal & Fils SASU", {"name_legal": "sasu"}),
    ("Fractales Amis Groupe S.A.S", {"name_legal": "sas"}),
    ("Établissements Team", {"name_core": "team"}),
    ("ரெட் குளோபல் பிரைவேட் லிமிடெட்", {"name_core": "red global", "name_legal": "ltd pvt", "name_indic": True}),
]
MAP = {"ret": "red", "kulopl": "global", "piraivet": "pvt", "limitet": "ltd"}

ADDRESSES = [
    ("1795 Westchester Drive, High Point, NC", "US", {"addr_state": "north carolina", "addr_house_no": "1795", "addr_localities": "high pt"}),
    ("NC, HIGH POINT, 1795 WESTCHESTER DR", "US", {"addr_key": "1795 dr high pt westchester"}),
    ("1795 Westchester Dr, High Point, North Carolina", "US", {"addr_key": "1795 dr high pt westchester"}),
    ("1545 R Mount Read Blvd, NULL, PMB 4092, Rochester, New York", "US", {"addr_state": "new york", "addr_house_no": "1545", "addr_nums": "1545"}),
    ("4328-D ARCADIA LANE, PHOENIX, AZ", "US", {"addr_house_no": "4328"}),
    ("Unit 2007, 1111 Church Street, Nashville, TN", "US", {"addr_nums": "2007 1111"}),
    ("12 Main St, Raleigh, NC 27601", "US", {"addr_postcode": "27601"}),
    ("17560 Ellis Road, Tahlequah, OK", "US", {"addr_postcode": ""}),
    ("67/93, Tatabad Iii Street, Coimbatore, தமிழ்நாடு", "India", {"addr_state": "tamil nadu"}),
    ("67/93, Tatabad Iii Street, Coimbatore, TN", "India", {"addr_state": "tamil nadu"}),
    ("H.NO 7/72 E2, 7, ST-6, THAKKALIVILAI", "India", {"addr_nums": "7 72 2 6"}),
    ("304, 3Rd Floor 56 Eros Appartments Nehru Place, Delhi, South Delhi, Delhi", "India", {"addr_state": "delhi"}),
    ("20 Rue Parmentier, Dunkerque, Hauts-de-France", "France", {"addr_state": "hauts de france", "addr_key": "20 dunkerque parmentier rue"}),
    ("20 R. PARMENTIER, DUNKERQUE, Nord", "France", {"addr_key": "20 dunkerque parmentier rue"}),
    ("3 ALL BOIRON, PESSAC", "France", {"addr_street": "3 allee boiron", "addr_state": ""}),
    ("Calle Mayor 5, Madrid", "Spain", {"addr_house_no": "5", "addr_state": ""}),
    ("", "US", {"addr_empty": True}),
    ("825 B 54rd St, Seattle, WA", "US", {"addr_norm": "825 b 54th st seattle"}),
    ("8215 Fourteenth Pl, Broken Arrow, OK", "US", {"addr_street": "8215 14th pl"}),
    ("1 7nd Ave, X, NY", "US", {"addr_street": "1 7th ave"}),
    (None, "US", {"addr_empty": True, "addr_norm": ""}),
]


def test_names(spark):
    rows = n.normalize_names(spark.createDataFrame([(k, x) for k, (x, _) in enumerate(NAMES)], "k int, business_name string"), token_map=MAP).collect()
    for r in rows:
        assert {c: r[c] for c in NAMES[r.k][1]} == NAMES[r.k][1], NAMES[r.k][0]


def test_addresses(spark):
    data = [(k, a, c) for k, (a, c, _) in enumerate(ADDRESSES)]
    rows = n.normalize_addresses(spark.createDataFrame(data, "k int, business_address string, country string"), state_map={"tmilnatu": "tamil nadu"}).collect()
    for r in rows:
        assert {c: r[c] for c in ADDRESSES[r.k][2]} == ADDRESSES[r.k][2], ADDRESSES[r.k][0]


@pytest.mark.parametrize(("word", "want"), [("gujarat", "gjrt"), ("gujrat", "gjrt"), ("12", "12")])
def test_skeleton(spark, word, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(n.skeleton(F.lit(word))).first()[0] == want


def test_fold():
    assert n.fold("ரெட் குளோபல் பிரைவேட் லிமிடெட்") == "ret kulopl piraivet limitet"
    assert n.fold("தமிழ்நாடு") == "tmilnatu"
