"""Run configuration: tab-separated file, YAML file or mapping, with typed keys and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

#: Key in a file -> (field, kind, default). Keys, kinds and defaults are fixed by the format.
KEYS = {
    "DEM_File": ("dem", str, ""), "Stream_File": ("streams", str, ""), "LU_Raster_SameRes": ("cover", str, ""), "LU_Manning_n": ("roughness", str, ""),
    "Flow_File": ("flows", str, ""), "Flow_File_ID": ("flow_id", str, "COMID"), "Flow_File_BF": ("flow_base", str, ""), "Flow_File_QMax": ("flow_max", str, "qmax"), "StrmShp_File": ("reaches", str, ""),
    "X_Section_Dist": ("distance", float, 5000.0), "Degree_Manip": ("turn", float, 1.1), "Degree_Interval": ("turn_step", float, 1.0), "Low_Spot_Range": ("low_spot", int, 0),
    "Gen_Dir_Dist": ("direction_cells", int, 10), "Gen_Slope_Dist": ("slope_cells", int, 0), "Stream_Slope_Method": ("slope_method", str, "local_average"),
    "VDT_Database_NumIterations": ("increments", int, 15), "Bathy_Trap_H": ("bank_share", float, 0.2), "Bathy_Use_Banks": ("by_banks", bool, False), "FindBanksBasedOnLandCover": ("by_cover", bool, False),
    "Reach_Average_Curve_File": ("reach_curves", bool, False), "LC_Water_Value": ("water", int, 80), "Print_VDT_Database": ("vdt", str, ""), "Print_AP_Database": ("ap", str, ""), "Print_Curve_File": ("curves", str, ""),
    "XS_Out_File": ("sections", str, ""), "AROutBATHY": ("bathymetry", str, ""), "AROutFLOOD": ("flood", str, ""), "Manual_Cross_Sections_File": ("manual", str, ""),
}
METHODS = ("local_average", "local_average_corrected", "reach_average", "end_points")


def to_bool(value: object) -> bool:
    return str(value).strip().lower() in ("true", "1", "yes", "y")


@dataclass
class Config:
    dem: str = ""
    streams: str = ""
    cover: str = ""
    roughness: str = ""
    flows: str = ""
    flow_id: str = "COMID"
    flow_base: str = ""
    flow_max: str = "qmax"
    reaches: str = ""
    distance: float = 5000.0
    turn: float = 1.1
    turn_step: float = 1.0
    low_spot: int = 0
    direction_cells: int = 10
    slope_cells: int = 0
    slope_method: str = "local_average"
    increments: int = 15
    bank_share: float = 0.2
    by_banks: bool = False
    by_cover: bool = False
    reach_curves: bool = False
    water: int = 80
    vdt: str = ""
    ap: str = ""
    curves: str = ""
    sections: str = ""
    bathymetry: str = ""
    flood: str = ""
    manual: str = ""

    @classmethod
    def of(cls, values: dict) -> "Config":
        """From key -> value as in a file; the second name of the bathymetry output is accepted; unknown keys are kept out."""
        values = dict(values)
        values.setdefault("AROutBATHY", values.get("BATHY_Out_File", ""))
        made = {}
        for key, (name, kind, default) in KEYS.items():
            raw = values.get(key, "")
            made[name] = default if raw is None or str(raw).strip() == "" else to_bool(raw) if kind is bool else kind(float(raw)) if kind is int else kind(raw)
        return cls(**made).checked()

    @classmethod
    def read(cls, path: str) -> "Config":
        """The last of repeated keys counts; a key without a value is 1."""
        text = Path(path).read_text()
        if path.endswith((".yml", ".yaml")):
            import yaml

            return cls.of(yaml.safe_load(text) or {})
        values: dict[str, str] = {}
        for line in text.splitlines():
            parts = line.strip().split("\t") if "\t" in line else line.strip().split(None, 1)
            if parts and parts[0] and not parts[0].startswith("#"):
                values[parts[0].strip()] = parts[1].strip() if len(parts) > 1 and parts[1].strip() else "1"
        return cls.of(values)

    def checked(self) -> "Config":
        if self.slope_method not in METHODS:
            self.slope_method = "local_average"
        if self.slope_method == "end_points" and not self.reaches:
            raise ValueError("slope method end_points needs StrmShp_File")
        if not self.flow_base:
            self.bathymetry = ""  # there is nothing to size a channel by
        if not self.curves:
            self.reach_curves = False
        return self

    def write(self, path: str) -> None:
        """A template with every key and this configuration's values."""
        names = {name: key for key, (name, _, _) in KEYS.items()}
        Path(path).write_text("".join(f"{names[f.name]}\t{getattr(self, f.name)}\n" for f in fields(self)))
