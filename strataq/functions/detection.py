"""Patterns and tables of the source detectors.

All of this is fixed: the results must name the same algorithms for the same lines.
"""

# fixed values: Python, calls by library
PY_CRYPTOGRAPHY = r"(Fernet|AES|DES|TripleDES|RSA|DSA|ECDSA|Ed25519|X25519|SECP256K1|SECP384R1|SECP521R1|SHA256|SHA384|SHA512|SHA1|MD5|HMAC|PBKDF2|Scrypt|hashes\.(SHA|MD)|padding\.(PKCS|OAEP)|serialization\.)"
PY_CRYPTODOME = r"(Cipher\.AES|Cipher\.DES|Cipher\.DES3|Hash\.SHA256|Hash\.SHA512|Hash\.MD5|PublicKey\.RSA|PublicKey\.DSA|PublicKey\.ECC|Signature\.pkcs1_15|Signature\.pss)"
PY_HASHLIB = r"hashlib\.(sha256|sha384|sha512|sha1|md5|blake2b|blake2s|sha3_256|sha3_512|new)\s*\("
PY_HMAC = r"hmac\.(new|HMAC|compare_digest)\s*\("
PY_BCRYPT = r"bcrypt\.(hashpw|checkpw|gensalt|kdf)\s*\("
PY_JWT = r"jwt\.(encode|decode|api_jwt|api_jws)\s*\("
PY_PASSLIB = r"passlib\.(hash|context|pwd)\.(bcrypt|argon2|pbkdf2|sha256_crypt|sha512_crypt)"
PY_NACL = r"nacl\.(secret|public|signing|utils|hash)\.(SecretBox|Box|SigningKey|VerifyKey)"
PY_QUOTED = r"""['"](RS256|RS384|RS512|ES256|ES384|ES512|PS256|PS384|PS512|HS256|HS384|HS512|EdDSA|aes-\d+-\w+|des|3des|sha256|sha512|md5)['"]"""
PY_FUNCTION = r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\("
PY_CLASS = r"^(\s*)class\s+(\w+)"

# fixed values: Python, what a line contains, in order of trial
PY_CRYPTOGRAPHY_NAMES = (
    ("rsa", "RSA"),
    ("dsa", "DSA"),
    ("ecdsa", "ECDSA"),
    ("ed25519", "Ed25519"),
    ("x25519", "X25519"),
    ("secp256k1", "ECDSA"),
    ("secp384r1", "P-384"),
    ("secp521r1", "P-521"),
    ("aes", "AES"),
    ("tripledes", "3DES"),
    ("des", "DES"),
    ("chacha20", "ChaCha20"),
    ("fernet", "AES-128"),
    ("sha256", "SHA-256"),
    ("sha384", "SHA-384"),
    ("sha512", "SHA-512"),
    ("sha1", "SHA-1"),
    ("md5", "MD5"),
    ("pbkdf2", "PBKDF2"),
    ("scrypt", "scrypt"),
)
PY_CRYPTODOME_NAMES = (
    ("Cipher.AES", "AES"),
    ("Cipher.DES3", "3DES"),
    ("Cipher.DES", "DES"),
    ("Hash.SHA256", "SHA-256"),
    ("Hash.SHA512", "SHA-512"),
    ("Hash.MD5", "MD5"),
    ("PublicKey.RSA", "RSA"),
    ("PublicKey.DSA", "DSA"),
    ("PublicKey.ECC", "ECDSA"),
)
PY_HASHLIB_NAMES = (
    ("sha256", "SHA-256"),
    ("sha384", "SHA-384"),
    ("sha512", "SHA-512"),
    ("sha1", "SHA-1"),
    ("md5", "MD5"),
    ("blake2b", "BLAKE2b"),
    ("blake2s", "BLAKE2s"),
    ("sha3_256", "SHA3-256"),
    ("sha3_512", "SHA3-512"),
)
PY_HMAC_NAMES = (("sha256", "HMAC-SHA256"), ("sha512", "HMAC-SHA512"), ("sha1", "HMAC-SHA1"), ("md5", "HMAC-MD5"))
PY_JWT_NAMES = (("rs256", "RS256"), ("es256", "ES256"), ("hs256", "HS256"))
PY_PASSLIB_NAMES = (("bcrypt", "bcrypt"), ("argon2", "Argon2"), ("pbkdf2", "PBKDF2"), ("sha256_crypt", "SHA-256"), ("sha512_crypt", "SHA-512"))

# fixed values: JavaScript, calls by library
JS_CRYPTO = r"crypto\.(createCipher|createDecipher|createCipheriv|createDecipheriv|createSign|createVerify|createHash|createHmac|generateKeyPair|generateKeyPairSync|randomBytes|scrypt|scryptSync|pbkdf2|pbkdf2Sync)\s*\("
JS_BCRYPT = r"bcrypt\.(hash|compare|genSalt|hashSync|compareSync|genSaltSync)\s*\("
JS_JWT = r"(jwt|jsonwebtoken)\.(sign|verify|decode)\s*\("
JS_CRYPTOJS = r"CryptoJS\.(AES|DES|TripleDES|Rabbit|RC4|MD5|SHA1|SHA256|SHA512|SHA3|RIPEMD160|HmacMD5|HmacSHA1|HmacSHA256|HmacSHA512)\.(encrypt|decrypt|hash)\s*\("
JS_FORGE = r"forge\.(pki|cipher|md|hmac|random|util)\.(rsa|aes|des|md5|sha1|sha256|sha512)"
JS_QUOTED = r"""['"]([a-zA-Z0-9-]+)['"]"""
JS_FUNCTION = r"(?:async\s+)?function\s+(\w+)\s*\("
JS_ARROW = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
JS_METHOD = r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{"
JS_CLASS = r"class\s+(\w+)"
JS_EXPORT = r"^export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+(\w+)"
# fixed values: words before a bracket that are no methods
JS_STATEMENTS = ("if", "for", "while", "switch", "catch")

# fixed values: JavaScript, names in quotes
JS_NAMES = {
    "aes-128-cbc": "AES-128",
    "aes-192-cbc": "AES-192",
    "aes-256-cbc": "AES-256",
    "aes-128-gcm": "AES-128-GCM",
    "aes-256-gcm": "AES-256-GCM",
    "aes-128-ctr": "AES-128",
    "aes-256-ctr": "AES-256",
    "des": "DES",
    "des-ede3": "3DES",
    "des-ede3-cbc": "3DES",
    "rc4": "RC4",
    "md5": "MD5",
    "sha1": "SHA-1",
    "sha256": "SHA-256",
    "sha384": "SHA-384",
    "sha512": "SHA-512",
    "sha3-256": "SHA3-256",
    "sha3-512": "SHA3-512",
    "rsa": "RSA",
    "rsa-sha256": "RSA",
    "ecdsa": "ECDSA",
    "ed25519": "Ed25519",
    "x25519": "X25519",
    "curve25519": "X25519",
    "secp256k1": "ECDSA",
    "prime256v1": "P-256",
    "secp384r1": "P-384",
    "secp521r1": "P-521",
    "hs256": "HMAC-SHA256",
    "hs384": "HMAC-SHA384",
    "hs512": "HMAC-SHA512",
    "rs256": "RS256",
    "rs384": "RS384",
    "rs512": "RS512",
    "es256": "ES256",
    "es384": "ES384",
    "es512": "ES512",
    "ps256": "PS256",
    "ps384": "PS384",
    "ps512": "PS512",
}
# fixed values: JavaScript, what a call means without such a name
JS_METHODS = {
    "createHash": "SHA-256",
    "createHmac": "HMAC-SHA256",
    "createSign": "RSA",
    "createVerify": "RSA",
    "scrypt": "scrypt",
    "scryptSync": "scrypt",
    "pbkdf2": "PBKDF2",
    "pbkdf2Sync": "PBKDF2",
}
JS_KEY_PAIRS = ("generateKeyPair", "generateKeyPairSync")
JS_KEY_PAIR_NAMES = (("rsa", "RSA"), ("ec", "ECDSA"), ("ed25519", "Ed25519"))
JS_JWT_NAMES = (
    ("rs256", "RS256"),
    ("rs384", "RS384"),
    ("rs512", "RS512"),
    ("es256", "ES256"),
    ("es384", "ES384"),
    ("es512", "ES512"),
    ("ps256", "PS256"),
    ("ps384", "PS384"),
    ("ps512", "PS512"),
    ("hs256", "HS256"),
    ("hs384", "HS384"),
    ("hs512", "HS512"),
    ("eddsa", "EdDSA"),
)
JS_CRYPTOJS_NAMES = {
    "AES": "AES",
    "DES": "DES",
    "TripleDES": "3DES",
    "Rabbit": "Rabbit",
    "RC4": "RC4",
    "MD5": "MD5",
    "SHA1": "SHA-1",
    "SHA256": "SHA-256",
    "SHA512": "SHA-512",
    "SHA3": "SHA3",
    "RIPEMD160": "RIPEMD-160",
    "HmacMD5": "HMAC-MD5",
    "HmacSHA1": "HMAC-SHA1",
    "HmacSHA256": "HMAC-SHA256",
    "HmacSHA512": "HMAC-SHA512",
}
JS_FORGE_NAMES = (("rsa", "RSA"), ("aes", "AES"), ("des", "DES"), ("md5", "MD5"), ("sha1", "SHA-1"), ("sha256", "SHA-256"), ("sha512", "SHA-512"))

# fixed values: Java, services whose algorithm is named in quotes
JAVA_SERVICES = ("Cipher", "MessageDigest", "KeyGenerator", "KeyPairGenerator", "Signature", "Mac", "KeyFactory", "KeyAgreement", "SecretKeyFactory")
# fixed values: Java, calls however the algorithm is named, and what they mean where nothing tells
JAVA_CALLS = (
    ("Cipher", r"(?:javax\.crypto\.)?Cipher\.getInstance\s*\(", "AES"),
    ("MessageDigest", r"(?:java\.security\.)?MessageDigest\.getInstance\s*\(", "SHA-256"),
    ("KeyGenerator", r"(?:javax\.crypto\.)?KeyGenerator\.getInstance\s*\(", "AES"),
    ("KeyPairGenerator", r"KeyPairGenerator\.getInstance\s*\(", "RSA"),
    ("Signature", r"(?:java\.security\.)?Signature\.getInstance\s*\(", "RSA"),
    ("Mac", r"(?:javax\.crypto\.)?Mac\.getInstance\s*\(", "HMAC"),
    ("SecureRandom", r"SecureRandom\.getInstance\s*\(", "SecureRandom"),
    ("SecretKeySpec", r"new\s+SecretKeySpec\s*\(", "AES"),
)
JAVA_HINT = r"(?i)(Aes|Des|Rsa|Ecdsa|Dsa|Blowfish|Twofish|Chacha|Salsa|Sha256|Sha512|Md5|Hmac|Pbkdf|Bcrypt|Scrypt|Argon)"
JAVA_BOUNCY = r"new\s+(AES|DES|RSA|ECDSA|Ed25519|SHA256|SHA512|MD5|Blowfish|Twofish|ChaCha20|Salsa20|PBKDF2|Argon2|BCrypt|SCrypt)"
JAVA_SPRING = r"(BCryptPasswordEncoder|Argon2PasswordEncoder|SCryptPasswordEncoder|Pbkdf2PasswordEncoder|StandardPasswordEncoder)"
JAVA_CLASS = r"^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:final\s+)?class\s+(\w+)"
JAVA_METHOD = r"^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\("

# fixed values: Java, algorithm names
JAVA_NAMES = {
    "AES": "AES",
    "AES/CBC/PKCS5Padding": "AES",
    "AES/GCM/NoPadding": "AES-GCM",
    "AES/ECB/PKCS5Padding": "AES-ECB",
    "AES/CTR/NoPadding": "AES",
    "DES": "DES",
    "DES/CBC/PKCS5Padding": "DES",
    "DESede": "3DES",
    "DESede/CBC/PKCS5Padding": "3DES",
    "RSA": "RSA",
    "RSA/ECB/PKCS1Padding": "RSA",
    "RSA/ECB/OAEPWithSHA-256AndMGF1Padding": "RSA-OAEP",
    "Blowfish": "Blowfish",
    "RC4": "RC4",
    "ChaCha20": "ChaCha20",
    "ChaCha20-Poly1305": "ChaCha20-Poly1305",
    "MD5": "MD5",
    "SHA-1": "SHA-1",
    "SHA1": "SHA-1",
    "SHA-256": "SHA-256",
    "SHA256": "SHA-256",
    "SHA-384": "SHA-384",
    "SHA384": "SHA-384",
    "SHA-512": "SHA-512",
    "SHA512": "SHA-512",
    "SHA3-256": "SHA3-256",
    "SHA3-512": "SHA3-512",
    "SHA256withRSA": "RSA",
    "SHA384withRSA": "RSA",
    "SHA512withRSA": "RSA",
    "SHA256withECDSA": "ECDSA",
    "SHA384withECDSA": "ECDSA",
    "SHA512withECDSA": "ECDSA",
    "SHA256withDSA": "DSA",
    "Ed25519": "Ed25519",
    "Ed448": "Ed448",
    "HmacMD5": "HMAC-MD5",
    "HmacSHA1": "HMAC-SHA1",
    "HmacSHA256": "HMAC-SHA256",
    "HmacSHA384": "HMAC-SHA384",
    "HmacSHA512": "HMAC-SHA512",
    "DH": "DH",
    "ECDH": "ECDH",
    "X25519": "X25519",
    "X448": "X448",
    "XDH": "X25519",
    "EC": "ECDSA",
    "DSA": "DSA",
    "PBKDF2WithHmacSHA256": "PBKDF2",
    "PBKDF2WithHmacSHA512": "PBKDF2",
    "PBEWithMD5AndDES": "DES",
    "PBEWithSHA1AndDESede": "3DES",
}
# fixed values: Java, all that an upper-case name of another form contains, in order of trial
JAVA_PARTS = (
    (("AES", "GCM"), "AES-GCM"),
    (("AES",), "AES"),
    (("RSA",), "RSA"),
    (("ECDSA",), "ECDSA"),
    (("SHA256",), "SHA-256"),
    (("SHA-256",), "SHA-256"),
    (("SHA512",), "SHA-512"),
    (("SHA-512",), "SHA-512"),
    (("MD5",), "MD5"),
    (("3DES",), "3DES"),
    (("DESEDE",), "3DES"),
    (("DES", "TRIPLE"), "3DES"),
    (("DES",), "DES"),
)
JAVA_HINT_NAMES = {
    "AES": "AES",
    "DES": "DES",
    "RSA": "RSA",
    "ECDSA": "ECDSA",
    "DSA": "DSA",
    "BLOWFISH": "Blowfish",
    "TWOFISH": "Twofish",
    "CHACHA": "ChaCha20",
    "SALSA": "Salsa20",
    "SHA256": "SHA-256",
    "SHA512": "SHA-512",
    "MD5": "MD5",
    "HMAC": "HMAC",
    "PBKDF": "PBKDF2",
    "BCRYPT": "bcrypt",
    "SCRYPT": "scrypt",
    "ARGON": "Argon2",
}
JAVA_SPRING_NAMES = {
    "BCryptPasswordEncoder": "bcrypt",
    "Argon2PasswordEncoder": "Argon2",
    "SCryptPasswordEncoder": "scrypt",
    "Pbkdf2PasswordEncoder": "PBKDF2",
    "StandardPasswordEncoder": "SHA-256",
}

# fixed values: Go, what an import path contains and the algorithm of its functions, in order of trial
GO_PATHS = (
    ("crypto/rsa", "RSA"),
    ("crypto/ecdsa", "ECDSA"),
    ("crypto/ed25519", "Ed25519"),
    ("crypto/aes", "AES"),
    ("crypto/des", "DES"),
    ("crypto/sha256", "SHA-256"),
    ("crypto/sha512", "SHA-512"),
    ("crypto/sha1", "SHA-1"),
    ("crypto/md5", "MD5"),
    ("crypto/rc4", "RC4"),
    ("crypto/dsa", "DSA"),
    ("crypto/ecdh", "ECDH"),
    ("crypto/elliptic", "ECDSA"),
    ("x/crypto/chacha20", "ChaCha20"),
    ("x/crypto/curve25519", "X25519"),
    ("x/crypto/bcrypt", "bcrypt"),
    ("x/crypto/argon2", "Argon2"),
    ("x/crypto/scrypt", "scrypt"),
    ("x/crypto/sha3", "SHA3"),
)
# fixed values: Go, paths whose functions tell more by their lower-case names
GO_FUNCTIONS = {
    "crypto/des": (("triple", "3DES"), ("3des", "3DES")),
    "crypto/elliptic": (("p256", "P-256"), ("p384", "P-384"), ("p521", "P-521")),
}
# fixed values: Go, lower-case names of types and functions that count without a call
GO_OPERATIONS = ("publickey", "privatekey", "generatekey", "newcipher", "new", "sum", "sign", "verify", "encrypt", "decrypt")

# fixed values: files that are read, by language: endings, folders never entered, names left out
SOURCE_FILES = {
    "go": ((".go",), ("vendor",), r"_test\.go$"),
    "python": ((".py",), ("__pycache__", ".git", "venv", ".venv", "env", ".env", "tests", "test"), r"^test_|_test\.py$|^conftest\.py$"),
    "javascript": ((".js", ".mjs", ".cjs", ".ts", ".tsx"), ("node_modules", ".git", "test", "tests", "__tests__"), r"\.test\.|\.spec\.|_test\.js$|\.min\.js$"),
    "java": ((".java", ".kt", ".kts"), (".git", "target", "build", "test", "tests", "node_modules"), r"Test\.java$|Tests\.java$|Test\.kt$"),
}
# fixed values: the language of an ecosystem's sources
LANGUAGE_OF = {"go": "go", "npm": "javascript", "pypi": "python", "maven": "java"}
