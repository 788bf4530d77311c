"""Fixed values of the traffic model and the dimension tables made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -----------------------------------------------------------------------------------------------
PCU = {"motorcycle": 0.24, "car": 1.0, "bus": 2.5, "truck": 2.5, "container": 2.5, "ambulance": 1.0, "police": 1.0, "firetruck": 2.5}
DIRECTIONS = ("North", "South", "East", "West")
BOUND = {"North": "NORTHBOUND", "South": "SOUTHBOUND", "East": "EASTBOUND", "West": "WESTBOUND"}
MOVEMENT_OF_LANE = {0: "right", 1: "straight", 2: "left"}
NODE_TLS = {"A": "J1", "B": "J2", "C": "J3", "D": "J4"}
NODES = {
    "A": ("Nguyen Hue - Le Loi", 10.7769, 106.7009),
    "B": ("Dien Bien Phu - Hai Ba Trung", 10.7889, 106.6917),
    "C": ("Cong Hoa - Hoang Van Thu", 10.8005, 106.6520),
    "D": ("Vo Van Kiet - Nguyen Tri Phuong", 10.7550, 106.6700),
}
APPROACHES = {
    "J1": {"North": "J3J1", "East": "J2J1", "South": "S1J1", "West": "W1J1"},
    "J2": {"North": "J4J2", "East": "E1J2", "South": "S2J2", "West": "J1J2"},
    "J3": {"North": "N1J3", "East": "J4J3", "South": "J1J3", "West": "W2J3"},
    "J4": {"North": "N2J4", "East": "E2J4", "South": "J2J4", "West": "J3J4"},
}
PHASES = ("NS_GREEN", "NS_YELLOW", "EW_GREEN", "EW_YELLOW")
LINKS = [
    ("A_E_to_B_W", "J1J2", "A", "B", "East", "West"),
    ("B_W_to_A_E", "J2J1", "B", "A", "West", "East"),
    ("A_N_to_C_S", "J1J3", "A", "C", "North", "South"),
    ("C_S_to_A_N", "J3J1", "C", "A", "South", "North"),
    ("B_N_to_D_S", "J2J4", "B", "D", "North", "South"),
    ("D_S_to_B_N", "J4J2", "D", "B", "South", "North"),
    ("C_E_to_D_W", "J3J4", "C", "D", "East", "West"),
    ("D_W_to_C_E", "J4J3", "D", "C", "West", "East"),
]
SOURCES = [
    ("ns_w", "N1J3", "J1S1"),
    ("sn_w", "S1J1", "J3N1"),
    ("ns_e", "N2J4", "J2S2"),
    ("sn_e", "S2J2", "J4N2"),
    ("we_s", "W1J1", "J2E1"),
    ("ew_s", "E1J2", "J1W1"),
    ("we_n", "W2J3", "J4E2"),
    ("ew_n", "E2J4", "J3W2"),
]
DIAGONALS = [
    ("x1", "N1J3", "J2E1", "car"),
    ("x2", "S1J1", "J3W2", "motorcycle"),
    ("x3", "W1J1", "J4N2", "motorcycle"),
    ("x4", "E1J2", "J1S1", "car"),
    ("x5", "N2J4", "J1W1", "motorcycle"),
    ("x6", "S2J2", "J4E2", "car"),
    ("x7", "W2J3", "J2S2", "motorcycle"),
    ("x8", "E2J4", "J3N1", "bus"),
]
DEMAND = {
    "normal": dict.fromkeys([s[0] for s in SOURCES], 700),
    "morning_peak": {"ns_w": 1800, "sn_w": 1600, "ns_e": 1800, "sn_e": 1400, "we_s": 1600, "ew_s": 700, "we_n": 1400, "ew_n": 700},
    "evening_peak": {"ns_w": 700, "sn_w": 1600, "ns_e": 700, "sn_e": 1800, "we_s": 700, "ew_s": 1800, "we_n": 700, "ew_n": 1600},
    "oversaturated": dict.fromkeys([s[0] for s in SOURCES], 2400),
}
CLASS_WEIGHTS = {"motorcycle": 0.85, "car": 0.12, "bus": 0.02, "truck": 0.01}
SPECIAL_SHARES = {"ambulance": 0.002, "police": 0.002, "firetruck": 0.001, "container": 0.005}
OVERLAY_PRIORITY = {"accident": 100, "blocked_intersection": 100, "downstream_restriction": 50, "heavy_rain": 10, "emergency": 90}
STATES = ("FREE_FLOW", "STABLE", "BUSY", "CONGESTED", "OVERSATURATED")
ROADS = [
    ("N1", "A", 200), ("A", "N1", 200), ("W1", "A", 250), ("A", "W1", 250), ("A", "B", 300), ("B", "A", 300),
    ("A", "C", 280), ("C", "A", 280), ("B", "E1", 220), ("E1", "B", 220), ("B", "D", 260), ("D", "B", 260),
    ("C", "D", 300), ("D", "C", 300), ("B", "S1", 340), ("S1", "B", 340), ("D", "E1", 300), ("E1", "D", 300),
    ("C", "S1", 200), ("S1", "C", 200), ("D", "E2", 210), ("E2", "D", 210),
]
# -----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Thresholds of the traffic model; every operator takes them as arguments with these defaults."""

    halting_ms: float = 0.1
    gap_m: float = 1.5
    pcu_fallback: float = 1.0
    approach_m: float = 470.0
    storage_m: float = 7.5
    free_kmh: float = 50.0
    jam_pcu_km: float = 200.0
    window_s: float = 45.0
    hold_s: float = 8.0
    recovery_s: float = 12.0
    spill_pressure: float = 0.85
    risk_pressure: float = 0.7
    slope: float = 0.05
    cause_from_s: float = 5.0
    cause_to_s: float = 120.0


MODEL = Model()


def pcu(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PCU.items()), "vtype string, pcu double")


def links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINKS, "link string, edge string, up string, dn string, up_direction string, dn_direction string")


def approaches(spark: SparkSession) -> DataFrame:
    rows = [(n, t, d, e, f"{e}_{i}", i) for n, t in NODE_TLS.items() for d, e in APPROACHES[t].items() for i in range(3)]
    return spark.createDataFrame(rows, "node_id string, tls_id string, direction string, edge string, lane_id string, lane_index int")


def turns(spark: SparkSession) -> DataFrame:
    """(approach edge, next edge, movement): right, straight, left clockwise from the approach, straight back otherwise."""
    clockwise = ("North", "West", "South", "East")
    out = []
    for edges in APPROACHES.values():
        leave = {d: e[2:] + e[:2] for d, e in edges.items()}
        for d, e in edges.items():
            k = clockwise.index(d)
            out += [(e, leave[clockwise[(k + j) % 4]], m) for j, m in ((1, "right"), (2, "straight"), (3, "left"), (0, "straight"))]
    return spark.createDataFrame(out, "from_edge string, to_edge string, movement string")


def phases(spark: SparkSession) -> DataFrame:
    """(phase index, name, direction, colour)."""
    color = lambda p, d: (p.split("_")[1].lower()) if d[0] in p.split("_")[0] else "red"
    return spark.createDataFrame([(k, p, d, color(p, d)) for k, p in enumerate(PHASES) for d in DIRECTIONS], "phase_index int, phase string, direction string, color string")


def roads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, float(m)) for a, b, m in ROADS], "src string, dst string, length_m double")
