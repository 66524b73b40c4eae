"""Coordinate systems as the text of a .prj file, from the keys of a GeoTIFF.

Geographic systems below and UTM zones on them are written by rule; other systems as a local one that names their code, for
there is no register of systems here.
"""

from __future__ import annotations

from ..operators.grid import Georef

#: Name, datum, spheroid, semi-major axis and inverse flattening of geographic systems by their code.
GEOGRAPHIC = {
    4326: ("GCS_WGS_1984", "D_WGS_1984", "WGS_1984", 6378137.0, 298.257223563),
    4269: ("GCS_North_American_1983", "D_North_American_1983", "GRS_1980", 6378137.0, 298.257222101),
    4258: ("GCS_ETRS_1989", "D_ETRS_1989", "GRS_1980", 6378137.0, 298.257222101),
    4617: ("GCS_North_American_1983_CSRS", "D_North_American_1983_CSRS", "GRS_1980", 6378137.0, 298.257222101),
}
#: By hundreds of the code, the geographic system of UTM zones, their name and hemisphere; the zone is what is left.
UTM = {326: (4326, "WGS_1984", "N"), 327: (4326, "WGS_1984", "S"), 269: (4269, "NAD_1983", "N"), 258: (4258, "ETRS_1989", "N")}


def _geographic(code: int) -> str:
    name, datum, spheroid, axis, flattening = GEOGRAPHIC[code]
    return f'GEOGCS["{name}",DATUM["{datum}",SPHEROID["{spheroid}",{axis},{flattening}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def wkt(code: int) -> str:
    """The text for an EPSG code."""
    if code in GEOGRAPHIC:
        return _geographic(code)
    zone = code % 100
    if code // 100 in UTM and 1 <= zone <= 60:
        base, name, side = UTM[code // 100]
        settings = {"False_Easting": 500000.0, "False_Northing": 10000000.0 if side == "S" else 0.0, "Central_Meridian": 6.0 * zone - 183, "Scale_Factor": 0.9996, "Latitude_Of_Origin": 0.0}
        told = "".join(f'PARAMETER["{k}",{v}],' for k, v in settings.items())
        return f'PROJCS["{name}_UTM_Zone_{zone}{side}",{_geographic(base)},PROJECTION["Transverse_Mercator"],{told}UNIT["Meter",1.0]]'
    return f'LOCAL_CS["EPSG:{code}",UNIT["Meter",1.0],AUTHORITY["EPSG","{code}"]]'


def prj(geo: Georef) -> str:
    """The text of a .prj file; nothing for a grid without a coordinate system."""
    if geo.epsg and geo.epsg != 32767:  # the code of a system that the user defines
        return wkt(geo.epsg)
    named = geo.names.split("|")[0].replace('"', "")
    return f'LOCAL_CS["{named}",UNIT["Meter",1.0]]' if named else ""
