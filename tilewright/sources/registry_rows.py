"""The shipped registry of open datasets and of question rules.

Fixed values: identifiers, periods, coverages, asset names, addresses, keyword patterns and need lists decide results,
so they are stated as they are.  Descriptions and reasons are ours.
"""

GLOBAL = "global"


def _source(id, name, themes, kind, shape, res, frm, to, revisit, coverage, licence, driver, cloud=False, note="", **access):
    return {"id": id, "name": name, "themes": themes, "kind": kind, "shape": shape, "resolution_m": res,
            "temporal": {"type": "series" if shape in ("series", "events") else "static", "from": frm, "to": to, "revisit_days": revisit},
            "coverage": coverage, "license": licence, "analysis_ready": True, "cloud_dependent": cloud, "description": note,
            "access": {"driver": driver, **access}}


_OPTICAL_THEMES = {"vegetation": ["red", "nir"], "water": ["green", "nir", "swir16"], "optical": ["red", "green", "blue", "nir"]}
_NASA = "NASA open data, no restrictions; needs a free Earthdata Login"
_MODIS = "No restrictions (NASA LP DAAC)"
_COPERNICUS = "Copernicus open data (free, attribution)"

SOURCES = [
    _source("sentinel-2-l2a", "Sentinel-2 L2A surface reflectance", ["optical", "vegetation", "water"], "raster", "series", 10.0,
            "2015-07", None, 5, GLOBAL, _COPERNICUS, "stac", cloud=True, note="Optical bands at 10 m.",
            provider="earth_search", collection="sentinel-2-l2a", group_by=["grid:code"],
            assets={"red": ["red"], "green": ["green"], "blue": ["blue"], "nir": ["nir"], "swir16": ["swir16"], "swir22": ["swir22"], "scl": ["scl"]},
            default_assets=["red", "nir"], theme_assets=_OPTICAL_THEMES),
    _source("sentinel-1-rtc", "Sentinel-1 radiometrically terrain-corrected backscatter (VV/VH)", ["sar", "water"], "raster", "series", 10.0,
            "2014-10", None, 6, GLOBAL, _COPERNICUS, "stac", note="C-band radar, independent of cloud.",
            provider="planetary_computer", collection="sentinel-1-rtc", group_by=["sat:relative_orbit"],
            assets={"vv": ["vv"], "vh": ["vh"]}, default_assets=["vv", "vh"]),
    _source("cop-dem-glo-30", "Copernicus DEM GLO-30", ["elevation"], "raster", "layer", 30.0, "2021", "2021", None, GLOBAL,
            "Copernicus DEM licence (free, attribution)", "stac", note="Global surface model.",
            provider="planetary_computer", collection="cop-dem-glo-30", assets={"elevation": ["data"]}, default_assets=["elevation"]),
    _source("esa-worldcover-2021", "ESA WorldCover 2021", ["landcover", "builtup", "vegetation"], "raster", "layer", 10.0, "2021", "2021", None,
            GLOBAL, "CC BY 4.0", "stac", note="Eleven land cover classes.",
            provider="planetary_computer", collection="esa-worldcover", assets={"landcover": ["map"]}, default_assets=["landcover"],
            query={"esa_worldcover:product_version": "2.0.0"}),
    _source("jrc-gsw-occurrence", "JRC Global Surface Water (1984–2020)", ["water"], "raster", "layer", 30.0, "1984", "2020", None, GLOBAL,
            "CC BY 4.0", "stac", note="Where water normally is.", provider="planetary_computer", collection="jrc-gsw",
            assets={"occurrence": ["occurrence"], "seasonality": ["seasonality"], "recurrence": ["recurrence"]},
            default_assets=["occurrence", "seasonality"], nodata=255.0),
    _source("io-lulc-annual", "Impact Observatory annual land use / land cover", ["landcover", "builtup"], "raster", "series", 10.0,
            "2017", "2023", 365, GLOBAL, "CC BY 4.0", "stac", note="Yearly classes from optical imagery.",
            provider="planetary_computer", collection="io-lulc-annual-v02", assets={"landcover": ["data"]}, default_assets=["landcover"],
            group_by=["proj:epsg"], planner="products"),
    _source("worldpop-constrained-2020", "WorldPop constrained population 2020 (100 m)", ["population"], "raster", "layer", 100.0,
            "2020", "2020", None, GLOBAL, "CC BY 4.0", "http", note="People per cell, one file per country.", mode="window",
            url="https://data.worldpop.org/GIS/Population/Global_2000_2020_Constrained/2020/BSGM/{iso3}/{iso3_lower}_ppp_2020_constrained.tif",
            assets={"population": ["file"]}),
    _source("chirps-monthly", "CHIRPS v2.0 monthly precipitation (0.05°)", ["precipitation"], "raster", "series", 5000.0,
            "1981-01", None, 30, [-180, -50, 180, 50], "Public domain (CHC/UCSB)", "http", note="Monthly rainfall totals.",
            mode="file_per_window", compression="gz",
            url="https://data.chc.ucsb.edu/products/CHIRPS-2.0/global_monthly/tifs/chirps-v2.0.{yyyy}.{mm}.tif.gz",
            assets={"precipitation": ["file"]}),
    _source("geoboundaries-adm2", "geoBoundaries ADM2 (districts)", ["boundaries"], "vector", "layer", None, "2023", "2023", None, GLOBAL,
            "CC BY 4.0", "http", note="District boundaries.", mode="vector",
            url="https://www.geoboundaries.org/api/current/gbOpen/{iso3}/ADM2/", assets={"boundaries": ["file"]}),
    _source("osm-roads", "OpenStreetMap roads (motorway–tertiary)", ["transport"], "vector", "query", None, "live", None, None, GLOBAL, "ODbL",
            "overpass", note="Road lines.", geometry="line", max_area_km2=50000.0, assets={"roads": ["file"]}),
    _source("osm-buildings", "OpenStreetMap buildings", ["buildings", "builtup"], "vector", "query", None, "live", None, None, GLOBAL, "ODbL",
            "overpass", note="Building outlines.", geometry="polygon", max_area_km2=2000.0, assets={"buildings": ["file"]}),
    _source("osm-waterways", "OpenStreetMap rivers, streams and canals", ["water", "hydrography"], "vector", "query", None, "live", None, None,
            GLOBAL, "ODbL", "overpass", note="Waterway lines.", geometry="line", max_area_km2=50000.0, assets={"waterways": ["file"]}),
    _source("gdacs-events", "GDACS disaster events", ["events"], "event", "events", None, "2000", None, 1, GLOBAL, "Open (GDACS/JRC)", "gdacs",
            note="Dated hazards with a location.", types={"flood": "FL", "cyclone": "TC", "earthquake": "EQ", "drought": "DR", "wildfire": "WF"}),
    _source("landsat-c2-l2", "Landsat Collection 2 Level-2 surface reflectance (Landsat 4–9)", ["optical", "vegetation", "water"], "raster",
            "series", 30.0, "1982-08", None, 8, GLOBAL, "Public domain (USGS)", "stac", cloud=True, note="The long optical record.",
            provider="planetary_computer", collection="landsat-c2-l2", planner="optical", group_by=["landsat:wrs_path", "landsat:wrs_row"],
            assets={"red": ["red"], "green": ["green"], "blue": ["blue"], "nir": ["nir08"], "swir16": ["swir16"], "swir22": ["swir22"], "qa": ["qa_pixel"]},
            default_assets=["red", "nir"], theme_assets=_OPTICAL_THEMES),
    _source("modis-ndvi-16day", "MODIS vegetation indices, 16-day composite, 250 m (MOD13Q1/MYD13Q1 v6.1)", ["vegetation"], "raster", "series",
            250.0, "2000-02", None, 16, GLOBAL, _MODIS, "stac", note="Cloud-screened NDVI composites.", provider="planetary_computer",
            collection="modis-13Q1-061", planner="products", group_by=["modis:tile-id"],
            assets={"ndvi": ["250m_16_days_NDVI"], "evi": ["250m_16_days_EVI"], "reliability": ["250m_16_days_pixel_reliability"]},
            default_assets=["ndvi", "reliability"]),
    _source("modis-lst-8day", "MODIS land surface temperature, 8-day, 1 km (MOD11A2/MYD11A2 v6.1)", ["temperature"], "raster", "series", 1000.0,
            "2000-02", None, 8, GLOBAL, _MODIS, "stac", note="Day and night surface temperature.", provider="planetary_computer",
            collection="modis-11A2-061", planner="products", group_by=["modis:tile-id"],
            assets={"lst_day": ["LST_Day_1km"], "lst_night": ["LST_Night_1km"]}, default_assets=["lst_day", "lst_night"]),
    _source("modis-burned-area", "MODIS burned area, monthly, 500 m (MCD64A1 v6.1)", ["fire"], "raster", "series", 500.0, "2000-11", "2025-07", 30,
            GLOBAL, _MODIS, "stac", note="Burn date per pixel and month.", provider="planetary_computer", collection="modis-64A1-061",
            planner="products", group_by=["modis:tile-id"], assets={"burn_date": ["Burn_Date"], "uncertainty": ["Burn_Date_Uncertainty"]},
            default_assets=["burn_date"]),
    _source("esa-cci-landcover", "ESA CCI / C3S land cover, annual, 300 m (1992–2020)", ["landcover", "builtup", "forest"], "raster", "series", 300.0,
            "1992", "2020", 365, GLOBAL, "Free with attribution (ESA CCI / Copernicus C3S)", "stac", note="Three decades of yearly land cover.",
            provider="planetary_computer", collection="esa-cci-lc", planner="products", group_by=["esa_cci_lc:tile"],
            assets={"landcover": ["lccs_class"]}, default_assets=["landcover"]),
    _source("alos-palsar-mosaic", "ALOS/ALOS-2 PALSAR annual L-band mosaic, 25 m (2015–2021)", ["sar", "forest"], "raster", "series", 25.0,
            "2015", "2021", 365, GLOBAL, "Free with attribution (JAXA)", "stac", note="Yearly L-band radar.", provider="planetary_computer",
            collection="alos-palsar-mosaic", planner="products", assets={"hh": ["HH"], "hv": ["HV"]}, default_assets=["hh", "hv"]),
    _source("nasadem", "NASADEM (SRTM reprocessed), 30 m", ["elevation"], "raster", "layer", 30.0, "2000", "2000", None, [-180, -56, 180, 60],
            "Public domain (NASA)", "stac", note="Void-filled elevation of February 2000.", provider="planetary_computer", collection="nasadem",
            assets={"elevation": ["elevation"]}, default_assets=["elevation"]),
    _source("soilgrids", "ISRIC SoilGrids 2.0, 250 m (topsoil 0–5 cm)", ["soil"], "raster", "layer", 250.0, "2020", "2020", None, GLOBAL,
            "CC BY 4.0 (ISRIC)", "http", note="Predicted soil properties.", mode="window",
            urls={k: f"https://files.isric.org/soilgrids/latest/data/{k}/{k}_0-5cm_mean.vrt" for k in ("soc", "clay", "sand", "phh2o")},
            assets={"soc": ["file"], "clay": ["file"], "sand": ["file"], "phh2o": ["file"]}),
    _source("hansen-gfc", "Hansen/UMD Global Forest Change 2000–2025 (v1.13), 30 m", ["forest"], "raster", "layer", 30.0, "2000", "2025", None,
            [-180, -60, 180, 80], "CC BY 4.0 (Hansen/UMD/Google/USGS/NASA)", "http", note="Tree cover and year of loss.", mode="tile_grid",
            tile_deg=10, nodata=255.0,
            url="https://storage.googleapis.com/earthenginepartners-hansen/GFC-2025-v1.13/Hansen_GFC-2025-v1.13_{layer}_{tile}.tif",
            assets={"treecover2000": ["treecover2000"], "lossyear": ["lossyear"]}),
    _source("geoboundaries-adm1", "geoBoundaries ADM1 (states / provinces)", ["boundaries"], "vector", "layer", None, "2023", "2023", None, GLOBAL,
            "CC BY 4.0", "http", note="First-level boundaries.", mode="vector",
            url="https://www.geoboundaries.org/api/current/gbOpen/{iso3}/ADM1/", assets={"boundaries": ["file"]}),
    _source("osm-facilities", "OpenStreetMap health and education facilities", ["facilities"], "vector", "query", None, "live", None, None, GLOBAL,
            "ODbL", "overpass", note="Service points.", geometry="point", max_area_km2=50000.0, assets={"facilities": ["file"]}),
    _source("hls-l30", "HLS Landsat 30 m surface reflectance (HLSL30 v2.0)", ["optical", "vegetation", "water"], "raster", "series", 30.0,
            "2013-04", None, 8, GLOBAL, _NASA, "stac", cloud=True, note="Landsat harmonised with Sentinel-2.", provider="nasa_lpcloud",
            collection="HLSL30_2.0", auth="earthdata", planner="optical", group_from_id=r"\.T(\w{5})\.",
            assets={"blue": ["B02"], "green": ["B03"], "red": ["B04"], "nir": ["B05"], "swir16": ["B06"], "swir22": ["B07"], "fmask": ["Fmask"]},
            default_assets=["red", "nir"], theme_assets=_OPTICAL_THEMES),
    _source("hls-s30", "HLS Sentinel-2 30 m surface reflectance (HLSS30 v2.0)", ["optical", "vegetation", "water"], "raster", "series", 30.0,
            "2015-11", None, 5, GLOBAL, _NASA, "stac", cloud=True, note="Sentinel-2 harmonised with Landsat.", provider="nasa_lpcloud",
            collection="HLSS30_2.0", auth="earthdata", planner="optical", group_from_id=r"\.T(\w{5})\.",
            assets={"blue": ["B02"], "green": ["B03"], "red": ["B04"], "nir": ["B8A"], "swir16": ["B11"], "swir22": ["B12"], "fmask": ["Fmask"]},
            default_assets=["red", "nir"], theme_assets=_OPTICAL_THEMES),
    _source("opera-dswx-hls", "OPERA dynamic surface water extent from HLS (DSWx-HLS v1)", ["surface_water"], "raster", "series", 30.0,
            "2023-04", None, 3, GLOBAL, _NASA, "stac", cloud=True, note="Classified open water per scene.", provider="nasa_pocloud",
            collection="OPERA_L3_DSWX-HLS_V1_1.0", auth="earthdata", planner="optical", nodata=255.0, group_from_id=r"_T(\w{5})_",
            assets={"water": ["0_B01_WTR", "1_B01_WTR"], "water_binary": ["0_B02_BWTR", "1_B02_BWTR"], "confidence": ["0_B03_CONF", "1_B03_CONF"]},
            default_assets=["water"]),
]


def _needs(*rows):
    return [{"theme": t, "temporal": m, "priority": p, "why": w, "prefer_cloud_independent": c}
            for t, m, p, w, c in (r if len(r) == 5 else (*r, False) for r in rows)]


def _rule(id, title, keywords, needs, event_type=None, default_years=None, examples=()):
    return {"id": id, "title": title, "keywords": keywords, "needs": needs, "event_type": event_type,
            "default_years": default_years, "examples": list(examples)}


RULES = [
    _rule("flood", "Flooding", [r"\bflood", "inundat", r"\bcyclone", "storm surge", "water ?logg"], _needs(
        ("sar", "pair", "required", "radar sees open water through cloud", True),
        ("optical", "pair", "recommended", "clear scenes validate the radar"),
        ("water", "static", "required", "separates new water from permanent water"),
        ("surface_water", "pair", "recommended", "ready-made open-water maps"),
        ("elevation", "static", "required", "low ground and flow direction"),
        ("population", "static", "recommended", "people exposed"),
        ("buildings", "static", "optional", "buildings exposed"),
        ("transport", "static", "optional", "roads disrupted"),
        ("hydrography", "static", "optional", "channels that carry the water"),
        ("facilities", "static", "optional", "services cut off")), event_type="flood",
        examples=["water covered the streets after the storm", "the river burst its banks"]),
    _rule("drought", "Drought", [r"\bdrought", "crop (stress|condition|failure)", "monsoon (failure|deficit)", "rain(fall)? deficit", "dry spell"], _needs(
        ("vegetation", "series", "required", "crop condition through time"),
        ("precipitation", "series", "required", "the rainfall deficit itself"),
        ("soil_moisture", "series", "recommended", "links rain and crop stress"),
        ("sar", "series", "optional", "covers cloudy months", True),
        ("landcover", "static", "recommended", "limits the study to cropland")),
        examples=["fields withered for want of rain", "the harvest was lost to the dry season"]),
    _rule("vegetation", "Vegetation and crops", [r"\bndvi", "vegetation (index|time ?series|monitoring|change)",
                                                  "crop (monitoring|phenology|growth|mapping|calendar)", "greenness", "forest (cover|loss|change)"], _needs(
        ("vegetation", "series", "required", "red and near-infrared through time"),
        ("landcover", "static", "optional", "mask of cropland and trees")),
        examples=["how green the fields are this season", "plant growth month by month"]),
    _rule("urban", "Urban growth", [r"\burban", r"built[- ]?up", "city (growth|expansion|sprawl)", "settlement (growth|expansion)", "urbani[sz]ation",
                                     "land use change"], _needs(
        ("builtup", "series", "required", "yearly built-up classes"),
        ("landcover", "series", "optional", "a longer land cover record"),
        ("optical", "series", "recommended", "imagery to look at"),
        ("population", "static", "recommended", "people per cell"),
        ("buildings", "static", "optional", "present outlines"),
        ("transport", "static", "optional", "roads that drive growth")), default_years=10,
        examples=["the town keeps spreading outwards", "farmland turned into housing"]),
    _rule("water_bodies", "Lakes, reservoirs and wetlands", [r"\b(reservoir|lake|wetland|tank|pond)s?\b", "surface water",
                                                              "water (extent|body|bodies|spread|level)"], _needs(
        ("water", "series", "required", "water extent through time"),
        ("water", "static", "recommended", "long-term baseline"),
        ("surface_water", "series", "recommended", "ready-made open-water maps"),
        ("optical", "series", "recommended", "bands for water indices")), default_years=5,
        examples=["is the lake shrinking", "how full is the dam"]),
    _rule("terrain", "Terrain and slope", [r"\b(slope|terrain|elevation|watershed|catchment|hillshade|landslides?|runoff)\b", r"\bdem\b"], _needs(
        ("elevation", "static", "required", "elevation model"),), examples=["how steep are these hills", "find the stream's drainage area"]),
    _rule("access", "Roads and access", [r"\broad", "accessib", "connectivity", r"\broute", "transport"], _needs(
        ("transport", "static", "required", "road lines"),
        ("population", "static", "recommended", "people served")), examples=["distance from villages to a highway", "remote places without transport"]),
    _rule("boundaries", "Administrative areas", ["district", "admin(istrative)? (boundar|unit)", "taluk", "block", "village boundar"], _needs(
        ("boundaries", "static", "optional", "units to aggregate by"),), examples=["totals for each county", "summaries by administrative unit"]),
    _rule("rainfall", "Rainfall", [r"\brain(fall|s|y|ed)?\b", "precipitation", r"\bmonsoon"], _needs(
        ("precipitation", "series", "required", "rain totals over the period"),), examples=["monthly rain amounts", "was it wetter than normal"]),
    _rule("forest", "Forest change", [r"\bforest", "deforest", "tree cover", "canopy", "logging", "mangrove"], _needs(
        ("forest", "static", "required", "tree cover and year of loss"),
        ("landcover", "series", "recommended", "what replaced the trees"),
        ("optical", "series", "optional", "imagery of recent change")), default_years=10,
        examples=["where trees were felled", "jungle lost in ten years"]),
    _rule("fire", "Fires and burned area", [r"\bfires?\b", "wildfire", r"\bburn", "stubble"], _needs(
        ("fire", "series", "required", "burned area by month"),
        ("vegetation", "series", "recommended", "plants before and after"),
        ("landcover", "static", "recommended", "what burned")), examples=["scorched land this year", "where crop residue was burned"]),
    _rule("heat", "Heat and land temperature", [r"\bheat", "temperature", r"\blst\b", "hot ?spot", "thermal"], _needs(
        ("temperature", "series", "required", "day and night surface temperature"),
        ("builtup", "static", "recommended", "built-up land stores heat"),
        ("vegetation", "series", "optional", "plants cool the surface")), examples=["hottest parts of the city", "how warm the ground gets"]),
    _rule("soil", "Soil properties", [r"\bsoils?\b", "erosion", "fertility", "organic carbon", r"\bph\b"], _needs(
        ("soil", "static", "required", "carbon, texture and acidity"),
        ("elevation", "static", "recommended", "slope drives erosion"),
        ("landcover", "static", "recommended", "use of the land")), examples=["is this land fertile", "clay content of the fields"]),
    _rule("services", "Health and education services", ["hospital", "school", "clinic", "health (care|facilit|access)", "facilit",
                                                         "service (access|coverage)"], _needs(
        ("facilities", "static", "required", "where services are"),
        ("transport", "static", "required", "how people reach them"),
        ("population", "static", "recommended", "who they serve"),
        ("boundaries", "static", "optional", "units for summaries")), examples=["villages far from a doctor", "children without a school nearby"]),
]
