"""Names, prefixes, patterns and bounds that results depend on."""

# ---- fixed values: slicing seeds ----
SEED_NAMES = (
    "getDeviceId", "getSubscriberId", "getSimSerialNumber", "getLine1Number", "getImei", "getMeid", "getAndroidId",
    "sendTextMessage", "sendMultipartTextMessage", "sendDataMessage",
    "getLastKnownLocation", "requestLocationUpdates",
    "forName", "getDeclaredMethod", "getDeclaredField", "invoke", "newInstance",
    "exec", "loadLibrary", "load",
    "startRecording", "takePicture",
    "getInstalledPackages", "getInstalledApplications",
)
CONTEXT_NAMES = (
    "getNetworkInfo", "getActiveNetworkInfo", "getMacAddress", "getConnectionInfo", "getSimOperator",
    "openFileOutput", "openFileInput", "getExternalStorageDirectory", "getExternalFilesDir",
    "doFinal", "update", "getMethod", "query",
)
CONTEXT_FRAGMENTS = (
    "TelephonyManager", "LocationManager", "SmsManager", "NetworkInfo", "ConnectivityManager", "WifiManager", "WifiInfo", "Runtime",
    "Cipher", "ContentResolver", "PackageManager", "MediaRecorder", "Camera", "CameraManager", "Environment", "Context",
)
LOADER_NAMES, LOADER_FRAGMENTS = ("loadClass", "<init>"), ("ClassLoader",)
SOCKET_NAMES, SOCKET_FRAGMENTS = ("openConnection", "connect", "getOutputStream"), ("URL", "Socket")

# ---- fixed values: framework filter ----
FRAMEWORK_PREFIXES = (
    "android.", "androidx.", "java.", "javax.",
    "com.google.ads.", "com.google.android.gms.", "com.google.android.youtube.", "com.google.android.maps.", "com.google.gson.", "com.google.firebase.",
    "com.facebook.", "com.squareup.", "com.unity3d.", "com.crashlytics.", "io.fabric.", "com.flurry.", "org.apache.", "dalvik.",
)
ALWAYS_SENSITIVE = (
    "exec", "dexclassloader", "loadclass", "<init>",
    "getdeviceid", "getsubscriberid", "getline1number", "getimei", "getmeid", "getsimoperator", "getsimserialnumber", "getandroidid",
    "getlastknownlocation", "requestlocationupdates",
    "sendtextmessage", "sendmultiparttextmessage", "senddatamessage",
    "query", "getmacaddress", "getconnectioninfo",
    "openfileoutput", "openfileinput", "getexternalstoragedirectory", "getexternalfilesdir",
    "openconnection", "connect", "getoutputstream", "dofinal", "update",
    "setcomponentenabledsetting", "takepicture", "startrecording", "getinstalledpackages", "getinstalledapplications",
)

# ---- fixed values: API categories (in this order), types and priorities ----
API_CATEGORIES = {
    "reflection": ("forname", "newinstance", "getdeclaredmethod", "getdeclaredfield", "getmethod", "invoke", "load", "loadlibrary"),
    "telephony": ("getdeviceid", "getsubscriberid", "getline1number", "getimei", "getmeid", "getsimoperator", "getsimserialnumber", "getandroidid"),
    "location": ("getlastknownlocation", "requestlocationupdates"),
    "sms": ("sendtextmessage", "sendmultiparttextmessage", "senddatamessage"),
    "network": ("openconnection", "connect", "getoutputstream", "getactivenetworkinfo", "getmacaddress", "getconnectioninfo"),
    "storage": ("openfileoutput", "openfileinput", "getexternalstoragedirectory", "getexternalfilesdir"),
    "crypto": ("dofinal", "update"),
    "exec": ("exec",),
    "content_resolver": ("query",),
    "dynamic_loading": ("dexclassloader", "loadclass"),
}
TRANSFER_APIS = (
    "sendTextMessage", "sendMultipartTextMessage", "sendDataMessage", "openFileOutput", "exec", "loadLibrary", "load",
    "doFinal", "update", "invoke", "startRecording", "openConnection", "connect", "getOutputStream",
)
HIGH_RISK_APIS = (
    "sendTextMessage", "sendMultipartTextMessage", "DexClassLoader", "dalvik.system.DexClassLoader",
    "getDeviceId", "getSubscriberId", "getSimSerialNumber", "getLine1Number", "getMacAddress",
    "exec", "loadLibrary", "openFileOutput", "getOutputStream", "openConnection",
    "loadClass", "setComponentEnabledSetting", "getLastKnownLocation", "requestLocationUpdates",
)
FIRST_PRIORITY = ("dexclassloader", "loadclass", "sendtextmessage", "getdeviceid", "getsubscriberid", "exec")
SECOND_PRIORITY = ("getlastknownlocation", "requestlocationupdates", "startrecording", "getinstalledpackages")

# ---- fixed values: statement types (first match wins) and path tokens ----
STATEMENT_TYPES = {
    "invoke": r"(virtual|static|special|interface)invoke",
    "assign": r"\$\w+\s*=\s*(?!@)",
    "identity": r":=\s*@(this|parameter|caughtexception)",
    "if_branch": r"\bif\b\s+\$",
    "return": r"\breturn\b",
    "cast": r"\(\s*[a-zA-Z][\w.]*\)\s*\$",
    "goto": r"\bgoto\b",
}
STRICT_BRANCH = r"\bif\b\s+\$"
PATH_PARAMETER = r":=\s*@(this|parameter\d+):\s*([\w.]+)"
PATH_INVOKE = r"<[\w.]+:\s+[\w.\[\]]+\s+([\w<>]+)\("
PATH_CAST = r"\((\w[\w.]*)\)\s*\$"
CALL = r"(?:virtualinvoke|staticinvoke|interfaceinvoke|specialinvoke|dynamicinvoke)\s+[^<]*<([^:]+):\s*([^\s(]+)\s+([^(]+)\(([^)]*)\)>"

# ---- fixed values: slice files ----
VERSION_MARK, BLOCK_MARK, END_MARK, NOTHING_FOUND = "=== SLICER_VERSION:", "=== FUNCTION:", "=== END FUNCTION", "NO_SUSPICIOUS_APIS_FOUND"
SLICER_VERSION = 2
FRESH_MARKERS = ("openConnection", "getOutputStream", "getSimOperator", "loadClass", "dexClassLoader", "<init>")

# ---- fixed values: packed archives ----
PACKERS = {
    "libjiagu.so": "Qihoo 360 / Jiagu",
    "libjiagu_art.so": "Qihoo 360 / Jiagu",
    "libprotectClass.so": "Qihoo 360",
    "libsecexe.so": "SecShell / Bangcle",
    "libSecShell.so": "SecShell / Bangcle",
    "libshell.so": "Tencent Legu",
    "libtx3g.so": "Tencent Legu",
    "libtup.so": "Tencent Legu",
    "libexec.so": "Ijiami",
    "libexecmain.so": "Ijiami",
    "libbaiduprotect.so": "Baidu Protect",
    "libAPKProtect.so": "APKProtect",
    "libchaosvmp.so": "ChaosVMP",
    "libkwscmm.so": "Kony",
    "libnqshield.so": "NQ Shield",
}
MISSING_DEX = "Missing classes.dex (Encrypted / Native payload)"

# ---- fixed values: verdicts in responses ----
SIGNALS = ("MALWARE", "MALICIOUS", "SPYWARE", "TROJAN", "ADWARE", "DATA HARVESTING", "DATA EXFILTRATION", "HIGHLY SUSPICIOUS", "SMS FRAUD", "HIDDEN AD")
SAYINGS = ("CLASSIFY THIS AS", "CLASSIFY THIS APPLICATION AS", "CLASSIFY AS", "VERDICT IS")

# ---- fixed values: published results that a report compares with (F1, FPR, FNR in percent) ----
PUBLISHED = (("published framework", 90.24, 1.26, 8.44), ("Drebin", 81.33, 0.40, 24.21), ("DeepDrebin", 71.92, 0.62, 34.12), ("Malscan", 66.37, 0.73, 46.83))

# ---- fixed values: bounds ----
EMBED_DIM = 384
SIMILARITY, NEIGHBOURS, MAX_QUERIES = 0.70, 5, 20
PROMPT_OVERHEAD, LEAST_BUDGET = 1_500, 500
TRUNCATED = "\n... [truncated] ..."
BUDGETS = {
    "openai": 80_000, "openrouter": 200_000, "openrouter-free": 30_000, "nvidia": 120_000, "groq": 4_000, "gemini": 800_000, "transformers": 32_768,
}
