"""Named sets of token ids that may be masked, as published: fixed values, results depend on every id."""

# fixed values, in natural order, one set a name
BABYLM_TOP = (1487, 1642, 1657, 1621, 2192, 2835, 3336, 983, 2589, 4483, 2084, 2647, 4398, 2636, 2925, 1318, 1100, 1210, 1767, 2540, 2058, 1690, 2222, 1466, 3730, 2626, 1917, 5156, 2479, 3511, 1597, 1762, 1494, 1336, 1551, 3589, 2832, 3863, 1285, 15967)
BKPS_TOP = (743, 4838, 1057, 2652, 3436, 1745, 3516, 3375, 8788, 2431, 966, 2356, 3612, 1545, 2354, 1109, 2300, 1103, 1719, 5770, 6364, 2642, 5938, 2626, 3505, 1573, 7926, 4978, 1854, 4692, 2187, 1661, 2035, 3492, 2506, 1862, 2077, 17841, 5055, 779)
BABYLM_CDI = (3952, 14720, 4771, 3491, 8212, 33847, 6507, 7872, 3881, 22045, 1702, 9686, 7779, 2366, 3211, 1382, 9280, 4929, 6576, 2029, 5897, 7545, 3714, 1323, 3424, 3195, 10481, 9245, 5044, 2648, 30860, 3654, 6729, 12607, 7586, 5445, 5465, 7815, 7765, 9875)
BKPS_CDI = (618, 1560, 534, 1182, 1965, 640, 2993, 835, 460, 1165, 1807, 866, 922, 826, 1239, 606, 691, 1521, 787, 1986, 2227, 994, 1309, 656, 772, 281, 625, 477, 783, 910, 3809, 757, 467, 2900, 991, 422, 3420, 517, 2936, 584)
SETS = {"BABYLM_TOP": BABYLM_TOP, "BKPS_TOP": BKPS_TOP, "BABYLM_CDI": BABYLM_CDI, "BKPS_CDI": BKPS_CDI}


def masked_ids(kind: str, name: str) -> tuple[int, ...]:
    """The ids of a named set; none where the kind of masking is ``none``."""
    if kind == "none":
        return ()
    if name not in SETS:
        raise ValueError(f"word sets are {', '.join(SETS)}")
    return SETS[name]
